"""Building blocks of the checking SQL (DuckDB dialect, RE2 patterns)."""

from __future__ import annotations

from ..operators.detectors import ATOM, LABEL

DOCS = "SELECT doc_id AS request_id, text FROM documents"

# RE2 forms of the detector patterns; \b is ASCII there.
DASH = r"[-\s]?"
RE_NATIONAL_ID = rf"\b\d{DASH}\d{{4}}{DASH}\d{{5}}{DASH}\d{{2}}{DASH}\d\b"
RE_CARD = r"\b(?:\d[ -]?){12,18}\d\b"
RE_IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
RE_IPV6 = r"(?i)[0-9a-f:]{2,39}"
RE_EMAIL = rf"{ATOM}+(?:\.{ATOM}+)*@{LABEL}(?:\.{LABEL})+"
RE_PHONES = (
    rf"\+66{DASH}(?:6|8|9)\d{DASH}\d{{3}}{DASH}\d{{4}}\b",
    rf"\b0(?:6|8|9)\d{DASH}\d{{3}}{DASH}\d{{4}}\b",
    rf"\b0[2-7]\d{DASH}\d{{3}}{DASH}\d{{4}}\b",
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_ctes(name: str, pattern: str, src: str = DOCS, keys: str = "request_id") -> str:
    """CTE chain ending in `name`(keys, text, v, cs, bs): matches with 0-based offsets."""
    p = lit(pattern)
    names = [k.strip() for k in keys.split(",")]
    held = ", ".join(names)
    return f"""
{name}_src AS ({src}),
{name}_arr AS (
  SELECT {held}, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS s
  FROM {name}_src WHERE regexp_matches(text, {p})),
{name}_un AS (
  SELECT {held}, text, unnest(m) AS v, unnest(s[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i
  FROM {name}_arr),
{name} AS (
  SELECT {held}, text, v, i,
    CAST(sum(length(gap)) OVER w + coalesce(sum(length(v)) OVER b, 0) AS INTEGER) AS cs,
    CAST(sum(strlen(gap)) OVER w + coalesce(sum(strlen(v)) OVER b, 0) AS INTEGER) AS bs
  FROM {name}_un
  WINDOW w AS (PARTITION BY {held} ORDER BY i),
         b AS (PARTITION BY {held} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def finding_cols(subtype: str, conf: float, value: str = "v") -> str:
    """Finding columns for a scan CTE; the span may be a trailing part of the match."""
    return f"""{lit(subtype)} AS subtype, CAST({conf} AS DOUBLE) AS confidence,
    CAST(bs + strlen(v) - strlen({value}) AS INTEGER) AS "start",
    CAST(bs + strlen(v) AS INTEGER) AS "end",
    CAST(cs + length(v) - length({value}) AS INTEGER) AS char_start,
    CAST(cs + length(v) AS INTEGER) AS char_end"""


DIGITS = "replace(replace(v, '-', ''), ' ', '')"


def national_id_ok(d: str) -> str:
    total = " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INTEGER) * {13 - i}" for i in range(12))
    return (
        f"(CASE WHEN regexp_full_match({d}, '[0-9]{{13}}') THEN "
        f"CAST(substr({d}, 13, 1) AS INTEGER) = (11 - ({total}) % 11) % 10 ELSE false END)"
    )


def luhn_ok(d: str) -> str:
    return (
        f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 1 THEN CAST(substr({d}, length({d}) - i + 1, 1) AS INTEGER) "
        f"WHEN CAST(substr({d}, length({d}) - i + 1, 1) AS INTEGER) > 4 "
        f"THEN 2 * CAST(substr({d}, length({d}) - i + 1, 1) AS INTEGER) - 9 "
        f"ELSE 2 * CAST(substr({d}, length({d}) - i + 1, 1) AS INTEGER) END)) % 10 = 0)"
    )


def card_ok(d: str) -> str:
    return (
        f"(CASE WHEN regexp_full_match({d}, '[0-9]{{13,19}}') THEN {luhn_ok(d)} "
        f"AND NOT (length({d}) = 13 AND {national_id_ok(d)}) ELSE false END)"
    )


EMAIL_OK = (
    "(cs = 0 OR NOT regexp_full_match(substr(text, cs, 1), '[._+A-Za-z0-9-]')) AND "
    "NOT regexp_full_match(substr(text, cs + length(v) + 1, 1), '[._+A-Za-z0-9-]') AND "
    "NOT contains(v, '..') AND length(v) - length(replace(v, '@', '')) = 1"
)
IPV4_OK = (
    "len(list_filter(string_split(v, '.'), lambda o: regexp_full_match(o, '0|[1-9][0-9]{0,2}') "
    "AND CAST(o AS INTEGER) <= 255)) = 4"
)


def v4_scope(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} IN (10, 127) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) "
        f"OR ({a} = 192 AND {b} = 168) OR ({a} = 169 AND {b} = 254) "
        "THEN 'private' ELSE 'public' END"
    )


IPV4_SCOPE = v4_scope(
    "CAST(string_split(v, '.')[1] AS INTEGER)", "CAST(string_split(v, '.')[2] AS INTEGER)"
)


def entropy(v: str) -> str:
    """Bits per character."""
    return (
        f"list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: "
        f"-((length({v}) - length(replace({v}, c, ''))) / length({v})) * "
        f"log2((length({v}) - length(replace({v}, c, ''))) / length({v}))))"
    )
