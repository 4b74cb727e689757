"""Driver tables mapped to library roles, registered queries and oracle SQL."""
