"""SQL that gives the same rows as the queries of operators that SQL can express."""

from __future__ import annotations

#: levels written out; a fan-out of 8 covers 8**9 rows of one group, and 8**4 groups
LEVELS, TOP = 9, 4


def _field(column: str, text: str | None = None) -> str:
    text = text or f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _upwards(first: str, key: str, levels: int, name: str) -> str:
    """Tables ``name0 ...``: nodes with their digest, the siblings left and right of them, and their number in the group."""
    run = f"(PARTITION BY {key}, pos // 8 ORDER BY pos"
    out = []
    for k in range(levels + 1):
        source = first if k == 0 else (
            f"SELECT {key}, pos // 8 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h "
            f"FROM {name}{k - 1} GROUP BY {key}, pos // 8"
        )
        out.append(
            f"{name}{k} AS (SELECT {key}, pos, h, count(*) OVER (PARTITION BY {key}) AS n, "
            f"coalesce(string_agg(h, '') OVER {run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER {run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({source}))"
        )
    return ",\n".join(out)


def _merkle() -> str:
    upper = "".join(map(chr, range(65, 91)))
    low = f"translate(text, '{upper}', '{upper.lower()}')"
    head = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), "
        "lambda c, one: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)))"
    )
    joins, proof = [], []
    for name, key, at, levels in (("t", "lang", "pos", LEVELS), ("u", "one", "seat", TOP)):
        for k in range(levels):
            step = f"{name}{k}"
            same = f"{step}.lang IS NOT DISTINCT FROM d.lang AND " if key == "lang" else ""
            joins.append(f"JOIN {step} ON {same}{step}.pos = d.{at} // {8**k}")
            proof.append(f"{step}.l || {step}.r")
    ways = [f"{n}{k}" for n, levels in (("t", LEVELS), ("u", TOP)) for k in range(levels)]
    steps = ", ".join(f"[{w}.l, {w}.r, {w}.n::VARCHAR]" for w in ways)
    folded = (
        f"list_reduce(list_prepend([d.f, '', ''], [{steps}]), lambda a, s: "
        "CASE WHEN s[3] = '1' THEN a ELSE [sha256(s[1] || a[1] || s[2]), '', ''] END)[1]"
    )
    return f"""
WITH leaves AS (
  SELECT doc_id, lang, sha256({head} || {_field("text", "text")}) AS h,
         CASE WHEN ({crc}) % 3 = 0 THEN sha256({head} || {_field("text", low)}) ELSE NULL END AS changed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves
),
{_upwards("SELECT lang, pos, h FROM placed", "lang", LEVELS, "t")},
seats AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS seat FROM t{LEVELS}),
{_upwards("SELECT 1 AS one, seat AS pos, h FROM seats", "one", TOP, "u")},
d AS (
  SELECT p.doc_id, p.lang, p.pos, p.h AS leaf, coalesce(p.changed, p.h) AS f, s.seat, s.h AS subroot, (SELECT h FROM u{TOP}) AS root
  FROM placed p JOIN seats s ON s.lang IS NOT DISTINCT FROM p.lang
), done AS (
  SELECT d.doc_id, d.leaf, d.subroot, d.root, sha256({" || ".join(proof)}) AS proof_sha256, {folded} AS folded_root
  FROM d {" ".join(joins)}
)
SELECT *, folded_root = root AS verified FROM done
"""


MERKLE = _merkle()

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT coalesce(isfinite(x), FALSE))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
