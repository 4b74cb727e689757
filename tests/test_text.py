import pytest
from pyspark.sql import functions as F

from bookloom.functions import series, text, values

# One pair or more for each way in which one book may be written twice.
SAME = [
    ("Tin Harbour Nights", "Odile Marsh", "Tin Harbour Nights", "Odile Marsh"),
    ("Nine Copper Doors", "Wen Haoran", "Nine Copper Doors", "Haoran Wen"),
    ("Salt Ledger", "Ruth A. Pell", "Salt Ledger", "Ruth A. Pell & Tom Agar"),
    ("Far Kilns", "Ivo & Petra Lund", "Far Kilns", "Ivo Lund & Petra Lund"),
    ("The Armour Maker", "G Holt", "The Armor Maker", "G Holt"),
    ("Low Meadow", "P. Q. Strand", "Low Meadow", "PQ Strand"),
    ("Ash Letters: Notes from a Quarry", "Lena Voss", "Ash Letters", "Lena Voss"),
    ("A Clock for Winter", "Bram Tyne", "Clock for Winter", "Bram Tyne"),
    ("Miller’s Ford", "Edda Crane", "Miller's Ford", "Edda Crane"),
    ("Organised Rain", "Strand, Pia", "organized rain", "pia strand"),
]
DIFFERENT = [
    ("Embers", "Hal Orrin", "Embers", "Mina Dace"),
    ("The Ferry", "Ada Moss", "The Ferry", "Ben Moss"),
    ("Tin Harbour Nights", "Odile Marsh", "Tin Harbour Days", "Odile Marsh"),
    ("Kelp", "Noor Vance", "Basalt", "Emil Rowe"),
]


def test_same_book_and_symmetry(spark):
    rows = [(*r, True) for r in SAME] + [(*r, False) for r in DIFFERENT]
    df = spark.createDataFrame(rows, "ta string, aa string, tb string, ab string, want boolean")
    out = df.select("*", text.same_book("ta", "aa", "tb", "ab").alias("got"),
                    text.same_book("tb", "ab", "ta", "aa").alias("back")).collect()
    assert all(r.got == r.want == r.back for r in out), out


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw,want", [
    ("P.Q. Strand", "pq strand"), ("Miller's Ford: A Ballad", "miller's ford"),
    ("Dace, Mina", "mina dace"), ("Moss & Vance", "moss and vance"),
    ("X Y Z Holt", "xyz holt"), ("a 1 b c", "1 bc"), ("kj p q", "kj pq"),
    ("Été Perdu (Part 9)", "été perdu"), ("“Marked” — Words", 'marked" - words'),
    ("Marsh, Ada and Lund", "marsh, ada and lund"), ("Red, Green, Blue", "red, green, blue"),
    (None, ""), ("  The   An Orchard ", "an orchard"),
])
def test_norm(spark, raw, want):
    assert one(spark, raw, text.norm) == want


@pytest.mark.parametrize("raw,want", [
    ("parlour", "parlor"), ("favour for a neighbour", "favor for a neighbor"), ("pour hours", "pour hours"),
    ("surprise", "surprize"), ("wise rise", "wise rise"), ("realisations", "realizations"),
    ("labours prised", "labors prized"), ("dour", "dour"),
])
def test_fold(spark, raw, want):
    assert one(spark, raw, text.title_fold) == want


@pytest.mark.parametrize("raw,want", [
    ("Book 12 (Lantern Guild Book 3)", ("lantern guild", 3.0)),
    ("Book 4 (River Courts #6)", ("river courts", 6.0)),
    ("Book 9 (Book 5 in Tides subseries)", ("tides", 5.0)), ("Book 9 (book 5 IN Tides)", ("tides", 5.0)),
    ("Book 2 (Tides, Book 2.5)", ("tides", 2.5)),
    ("Book 7 (Millers series #8)", ("millers", 8.0)), ("x (Millers subseries Book 8)", ("millers", 8.0)),
    ("x (Millers series, Book 8)", ("millers series", 8.0)), ("x (Series #8)", ("series", 8.0)),
    ("Book 2 (novella)", None), ("Book 2", None), (None, None), ("()", None), ("x (Book 2)", None),
    # A number must follow a blank and then #, or the word book and a blank.
    ("x (Tides Book#3)", None), ("x (Tides, Book#3)", None), ("x (Tides#3)", None), ("x (Tides,Book 3)", None),
    ("x (Tides Book3)", None), ("x (Tides # 3)", None), ("x (Tides Handbook 3)", None), ("x (Tides 3)", None),
    ("x (Tides Book ..)", None), ("x (Book .. in Tides #4)", ("book in tides", 4.0)),
    ("x (Tides, #3)", ("tides,", 3.0)), ("x (A series Book 1, Book 2)", ("series book 1", 2.0)),
    ("x (Wry #.5)", ("wry", 0.5)), ("x (Wryseries Book 2)", ("wryseries", 2.0)),
])
def test_subseries(spark, raw, want):
    got = one(spark, raw, series.subseries)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("raw,want", [
    ("Book 4 (River Courts #6)", "Book 4 (River Courts Book 6)"), ("Book 4 (River Courts Book 6)", None),
    ("Book 4 (novella)", None), ("Book 9 (Book 5.0 in Tides subseries) y", "Book 9 (Tides Book 5) y"), ("Book 4", None),
    ("x (Tides Book#3)", None), ("x (Tides, Book#3)", None), ("x (Tides #1.2.3)", "x (Tides Book 1.2.3)"),
])
def test_rewrite_position(spark, raw, want):
    assert one(spark, raw, series.rewrite_position) == want


@pytest.mark.parametrize("raw,want", [
    ("4", 4.0), (" 4.5 ", 4.5), (".5", 0.5), ("3.", 3.0), ("-2e1", -20.0), ("5d", None), ("4f", None), ("", None),
    ("n/a", None), (None, None), ("1,5", None)])
def test_number(spark, raw, want):
    assert one(spark, raw, text.number) == want


@pytest.mark.parametrize("raw,want", [
    ("1.0", "Book 1"), ("4.5", "Book 4.5"), ("0", None), ("", None), ("x", None), ("12", "Book 12"),
])
def test_index_to_position(spark, raw, want):
    assert one(spark, raw, series.index_to_position) == want


@pytest.mark.parametrize("raw,want", [
    ("7/4/2020", "2020-07-04"), ("2020-07-04", "2020-07-04"), ("7/4/20", "2020-07-04"),
    ("7/4/85", "1985-07-04"), ("2020/7/4", "2020-07-04"), ("July", None), ("", None),
])
def test_dates(spark, raw, want):
    got = one(spark, raw, values.parse_date)
    assert (str(got) if got else None) == want


def test_ppf_inverts_cdf(spark):
    import statistics
    dist = statistics.NormalDist()
    ps = [0.001, 0.01, 0.02425, 0.1, 0.5, 0.77, 0.98, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(values.norm_ppf(F.col("p"))).collect()]
    assert all(abs(g - dist.inv_cdf(p)) < 1e-7 for g, p in zip(got, ps))


def test_fuzzy_norm_sorts_comma_parts(spark):
    assert one(spark, "Moss & Dace", text.fuzzy_norm) == "dace moss"
    assert one(spark, "Yarrow, Birch: two", text.fuzzy_norm) == "birch"
