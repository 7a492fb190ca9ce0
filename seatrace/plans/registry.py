"""All queries outside of the corpus part."""

from . import domain, extra, tracks  # noqa: F401  domain and extra add their queries to those of tracks


def queries() -> dict:
    return dict(tracks.Q)


def oracle_sql() -> dict[str, str]:
    return dict(tracks.SQL)
