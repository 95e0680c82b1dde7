"""The same answers in DuckDB's SQL."""

ORACLES: dict[str, str] = {}

ORACLES["op7_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, (rn - 1) % 3 + 1 AS w, sum(source_size) OVER () AS total FROM s),
r AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / w, rn)),
c AS (SELECT *, (3 * source_size)::DOUBLE * open_w < w::DOUBLE * (total - held)::DOUBLE AS capped FROM r),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
    w::DOUBLE * (total - coalesce(sum(3 * source_size) FILTER (WHERE capped) OVER (), 0))::DOUBLE
      / (sum(w) FILTER (WHERE NOT capped) OVER ())::DOUBLE END AS target
  FROM c),
p AS (
  SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS repeats FROM t),
k AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.repeats, p.target - p.repeats * p.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS n
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (repeats + CASE WHEN upto <= budget OR (upto - n <= budget AND upto - budget < budget - (upto - n)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""

ORACLES["op8_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

ORACLES["op11_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT r, doc_id, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS all_terms FROM s),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
i AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(words) AS term FROM i)),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p JOIN (SELECT DISTINCT term FROM t) USING (term), a GROUP BY term, docs),
c AS (
  SELECT i, item_id, r, s.doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms))))::BIGINT AS score
  FROM t JOIN w USING (term) JOIN p USING (term) JOIN s USING (r), a GROUP BY i, item_id, r, s.doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES["op13_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS words FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT DISTINCT item, least(10, len(words)) AS size,
    array_to_string(words[k:k + least(10, len(words)) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(2, len(words) - 8))) AS k FROM i WHERE len(words) > 0)),
z AS (SELECT DISTINCT size FROM p),
o AS (
  SELECT r, b, size, array_to_string(words[b:b + size - 1], ' ') AS win
  FROM (SELECT r, words, size, unnest(range(1, (len(words) - size + 2)::BIGINT)) AS b FROM d, z WHERE len(words) >= size)),
f AS (SELECT DISTINCT r, b, size, item FROM o JOIN p USING (size, win)),
h AS (SELECT r, count(DISTINCT w)::BIGINT AS n_hit FROM (SELECT r, unnest(range(b, b + size)) AS w FROM f) GROUP BY r),
g AS (SELECT r, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM f GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)
"""


def _merkle_sql(levels: int = 24, lang_levels: int = 10) -> str:
    """A query for each level of the trees; ``levels`` bounds a language to 2**24 documents."""
    told = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END".format
    leaf = "sha256({})".format
    parts = [told("doc_id"), told("source"), told("lang"), "{}", told("text")]
    own, other = (leaf(" || ".join(parts).format(told(n))) for n in ("n_chars", "(n_chars::HUGEINT + 1)"))
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: "
        "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)")

    def tree(name: str, first: str, keys: str, count: int) -> list[str]:
        """name_0 (keys, i, h) is given; name_k by name_(k-1), groups of one node stay as they are."""
        out = [f"{name}_0 AS ({first})"]
        for k in range(count):
            out.append(
                f"{name}_{k + 1} AS (SELECT {keys}, i // CASE WHEN n > 1 THEN 2 ELSE 1 END AS i, "
                f"CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h "
                f"FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {name}_{k}) GROUP BY {keys}, n, i // CASE WHEN n > 1 THEN 2 ELSE 1 END)")
        return out

    def walk(name: str, start: str, base: str, keys: str, count: int) -> list[str]:
        """start (x, keys, i, f, proof) up the tree: i halves, f is folded, siblings are appended to proof."""
        out, last = [], start
        for k in range(count):
            n = f"(SELECT {keys} AS g, count(*) AS n FROM {base}_{k} GROUP BY {keys})"
            left, f, sib = ("xor(c.i, 1) < c.i", "c.f", "s.h")
            out.append(
                f"{name}_{k} AS (SELECT c.x, c.{keys}, CASE WHEN n > 1 THEN c.i // 2 ELSE c.i END AS i, "
                f"CASE WHEN n > 1 THEN sha256(CASE WHEN {sib} IS NULL THEN {f} WHEN {left} THEN {sib} || {f} ELSE {f} || {sib} END) ELSE {f} END AS f, "
                f"c.proof || CASE WHEN n > 1 THEN coalesce({sib}, '') ELSE '' END AS proof "
                f"FROM {last} c JOIN {n} m ON m.g IS NOT DISTINCT FROM c.{keys} "
                f"LEFT JOIN {base}_{k} s ON s.{keys} IS NOT DISTINCT FROM c.{keys} AND s.i = xor(c.i, 1) AND n > 1)")
            last = f"{name}_{k}"
        return out

    steps = [
        f"a AS (SELECT row_number() OVER () AS x, doc_id, lang, {own} AS leaf, "
        f"CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {other} ELSE {own} END AS altered FROM documents)",
        "b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, x) - 1 AS i FROM a)",
        *tree("t", "SELECT lang, i, leaf AS h FROM b", "lang", levels),
        f"r AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS no FROM t_{levels})",
        *tree("u", "SELECT 0 AS one, no AS i, subroot AS h FROM r", "one", lang_levels),
        "c_start AS (SELECT x, lang, i, altered AS f, '' AS proof FROM b)", *walk("c", "c_start", "t", "lang", levels),
        f"e_start AS (SELECT c.x, 0 AS one, r.no AS i, c.f, c.proof FROM c_{levels - 1} c JOIN r ON r.lang IS NOT DISTINCT FROM c.lang)",
        *walk("e", "e_start", "u", "one", lang_levels)]
    steps = [s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps]
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, leaf, subroot, u.h AS root, sha256(e.proof) AS proof_sha256, e.f AS folded_root, e.f = u.h AS verified\n"
        f"FROM b JOIN e_{lang_levels - 1} e USING (x) JOIN r ON r.lang IS NOT DISTINCT FROM b.lang CROSS JOIN u_{lang_levels} u")


ORACLES["op12_merkle_manifest"] = _merkle_sql()
