"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_B = r"[\x20\x09-\x0D]+"

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text AS raw, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM d JOIN w USING (rid)),
l AS (SELECT rid, source, raw, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1)) GROUP BY rid),
nl AS (SELECT rid, source, raw, trim(regexp_replace(lower(line), '{_B}', ' ', 'g')) AS line FROM l),
held AS (SELECT source, line, count(DISTINCT raw) AS held FROM nl GROUP BY ALL),
bad AS (SELECT source, line FROM held WHERE held > 10),
gone AS (SELECT rid, sum(len(string_split(nl.line, ' '))) AS removed FROM nl JOIN bad ON nl.source IS NOT DISTINCT FROM bad.source AND nl.line = bad.line GROUP BY rid),
x AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed FROM f LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed >= 0.8 * n_words AS kept FROM x"""

_ESCAPED = r"regexp_replace({x}, '<(\\*)\|', '<\\\1|', 'g')"
_ROLE = _ESCAPED.format(x=r"replace(replace(role, '\', '\\'), chr(10), '\n')")

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS probe FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok', true), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', true))
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(24 + length({_ROLE}) + length({_ESCAPED.format(x='text')}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id, probe"""

#: CRC-32 of a list of byte values; the table is a list of 256 from the generator polynomial.
_CRC_TABLE = "list_transform(range(256), lambda v: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v::BIGINT))"
_CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"
_BYTES = "flatten(list_transform(string_split({x}, ''), lambda v: CASE WHEN ord(v) < 128 THEN [ord(v)::BIGINT] ELSE [195::BIGINT, ord(v)::BIGINT - 64] END))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPELLING = rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc_table),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
told AS (SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, times, {_CRC.format(bytes=_BYTES.format(x="id || ':' || run"))} AS h FROM told, t),
noisy AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN other END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""

#: Levels of each of the manifest's trees that its SQL can climb: 8^7 rows of a language.
_CLIMBED = 7


def _manifest() -> str:
    said = lambda x: f"coalesce(strlen({x})::VARCHAR || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([said("doc_id::VARCHAR"), said("source"), said("lang"), said("n_chars::VARCHAR"), said(text)]) + ")"
    bytes_ = "list_transform(string_split(doc_id::VARCHAR, ''), lambda v: ord(v)::BIGINT)"
    out = [
        f"t AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc_table)",
        f"rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || lang, '0') AS tree, {leaf('text')} AS leaf, CASE WHEN {_CRC.format(bytes=bytes_)} % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other FROM documents, t)",
        "a0 AS (SELECT rid, doc_id, leaf, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, leaf AS node, coalesce(other, leaf) AS folded, '' AS proof FROM rows)",
    ]

    def climb(p: str) -> str:
        """Levels of the trees of p0 (tree, pos, node); each row follows its own node, with its altered copy and its proof."""
        for k in range(_CLIMBED):
            out.append(f"{p}r{k} AS (SELECT tree, pos // 8 AS up, string_agg(node, '' ORDER BY pos) AS run, max(count(*)) OVER (PARTITION BY tree) > 1 OR count(*) OVER (PARTITION BY tree) > 1 AS grows FROM (SELECT DISTINCT tree, pos, node FROM {p}{k}) GROUP BY tree, pos // 8)")
            left, right = "left(run, (64 * (pos % 8))::BIGINT)", "substr(run, (64 * (pos % 8) + 65)::BIGINT)"
            out.append(f"{p}{k + 1} AS (SELECT {{keep}}, x.tree, pos // 8 AS pos, CASE WHEN grows THEN sha256(run) ELSE node END AS node, CASE WHEN grows THEN sha256({left} || folded || {right}) ELSE folded END AS folded, CASE WHEN grows THEN proof || {left} || {right} ELSE proof END AS proof FROM {p}{k} x JOIN {p}r{k} y ON x.tree = y.tree AND x.pos // 8 = y.up)")
        return f"{p}{_CLIMBED}"

    top = climb("a")
    out.append(f"langs AS (SELECT tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS pos FROM (SELECT DISTINCT tree FROM {top}))")
    out.append(f"b0 AS (SELECT rid, doc_id, leaf, node AS subroot, '' AS tree, langs.pos, node, folded, proof FROM {top} x JOIN langs ON x.tree = langs.lang)")
    done = climb("b")
    ctes = [c.format(keep="rid, doc_id, leaf" + ", subroot" * c.startswith("b")) if "{keep}" in c else c for c in out]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM {done}"


MANIFEST = _manifest()

EMBEDDINGS = """WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
sound AS MATERIALIZED (SELECT rid, x, len(x) AS d, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM sound a JOIN sound b ON a.d = b.d AND a.rid <> b.rid WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.rid GROUP BY reach.a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v LEFT JOIN counts ON rid = counts.a JOIN low ON rid = low.a"""

ORACLES: dict[str, str] = {
    "op7_quality_rules": QUALITY,
    "op5_chat_format": CHAT,
    "op11_spelling_variants": SPELLING,
    "op12_merkle_manifest": MANIFEST,
    "op13_embedding_dedup": EMBEDDINGS,
}
