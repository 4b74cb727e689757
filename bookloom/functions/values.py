"""Ratings, dates, tags, buckets and the normal distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookloom.functions.series import index_to_position
from bookloom.functions.text import number

# Penalty for 0, 1, 2, 3 and 4-or-more rejections of one title.
REJECTION_PENALTIES = [0.0, 0.5, 1.5, 3.5, 6.0]

# Date spellings, tried in this order.
DATE_FORMS = ["M/d/yyyy", "yyyy-M-d", "M/d/yy", "yyyy/M/d"]

# Coefficients of Acklam's inverse normal approximation.
PPF_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
PPF_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]
PPF_TAIL = 0.02425

RECENT, MIDDLE, OLD, UNDATED = "<=12mo", "12-36mo", "3+yrs", "undated"


def parse_rating(c) -> Column:
    return number(c)


def parse_date(c) -> Column:
    """First date form that fits; two-digit years 69-99 are 19xx."""
    text = F.trim(c)
    tries = []
    for form in DATE_FORMS:
        day = F.try_to_timestamp(text, F.lit(form)).cast("date")
        if form.endswith("/yy"):
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        tries.append(day)
    return F.coalesce(*tries)


def first_filled(*cols) -> Column:
    """First non-empty value, trimmed."""
    return F.trim(F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))
                               for c in cols]))


def recency_bucket(day: Column, today: Column) -> Column:
    age = F.datediff(today, day)
    return (F.when(day.isNull(), UNDATED).when(age <= 365, RECENT)
            .when(age <= 3 * 365, MIDDLE).otherwise(OLD))


def _whole(c) -> Column:
    return number(c).try_cast("bigint")


def _year(c: Column) -> Column:
    y = c.try_cast("bigint")
    return F.when(y.between(1000, 2100), y)


def csv_owned(pages="pages", reviews="reviews", rating="rating", series="series",
              series_index="series_index", series_type="series_type",
              pubdate="pubdate", pub_year="pub_year") -> dict[str, Column]:
    """Values the library CSV owns.  Numbers are null when the CSV is silent; the
    series triple is authoritative even when null."""
    name = F.nullif(F.trim(F.coalesce(F.col(series), F.lit(""))), F.lit(""))
    explicit = _year(F.regexp_extract(F.trim(F.coalesce(F.col(pub_year), F.lit(""))),
                                      r"^(\d{4})$", 1))
    dated = _year(F.regexp_extract(F.coalesce(F.col(pubdate), F.lit("")), r"^(\d{4})", 1))
    return {
        "pages": _whole(pages),
        "reviews": _whole(reviews),
        "rating": number(rating),
        "series": name,
        "series_position": F.when(name.isNotNull(), index_to_position(series_index)),
        "series_status": F.nullif(F.trim(F.coalesce(F.col(series_type), F.lit(""))), F.lit("")),
        "pub_year": F.coalesce(explicit, dated),
    }


def norm_pdf(x: Column) -> Column:
    return F.exp(x * x * -0.5) / math.sqrt(2.0 * math.pi)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_ppf(p: Column) -> Column:
    """Inverse normal distribution on (0, 1); null outside."""
    def tail(q):
        return _poly(PPF_C, q) / _poly(PPF_D + [1.0], q)
    centre = p - 0.5
    r = centre * centre
    return (F.when((p > 0) & (p < PPF_TAIL), tail(F.sqrt(F.log(p) * -2.0)))
            .when((p < 1) & (p > 1 - PPF_TAIL), -tail(F.sqrt(F.log(1.0 - p) * -2.0)))
            .when((p > 0) & (p < 1), _poly(PPF_A, r) * centre / _poly(PPF_B + [1.0], r)))


def tag_array(c) -> Column:
    """Comma list -> trimmed, non-empty tags in order."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)),
                    lambda t: t != "")


def edit_tags(c, managed: dict[str, Column]) -> Column:
    """Drop the managed tags from a comma list, then append those whose flag is on."""
    kept = F.filter(tag_array(c), lambda t: ~t.isin(list(managed)))
    added = F.array_compact(F.array(*[F.when(on, F.lit(t)) for t, on in managed.items()]))
    return F.array_join(F.concat(kept, added), ", ")


def has_tag(c, tag: str) -> Column:
    return F.array_contains(tag_array(c), tag)


def rejection_penalty(n: Column) -> Column:
    steps = F.array(*[F.lit(p) for p in REJECTION_PENALTIES])
    capped = F.greatest(F.least(n, F.lit(len(REJECTION_PENALTIES) - 1)), F.lit(0))
    return F.element_at(steps, (capped + 1).cast("int"))


def page_bucket(pages: Column) -> Column:
    return (F.when(F.coalesce(pages, F.lit(0)) == 0, F.lit(None).cast("string"))
            .when(pages <= 350, "short").when(pages <= 600, "medium").otherwise("long"))


def fit_verdict(strength: Column) -> Column:
    return F.when(strength >= 0.9, "strong").when(strength >= 0.4, "medium").otherwise("weak")


def unit_hash(*parts) -> Column:
    """Uniform number in [0, 1) from the text of its parts: a seedable draw that
    does not depend on partitioning."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
