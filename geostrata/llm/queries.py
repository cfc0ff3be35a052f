"""The numbered queries of the training-data operators."""

from __future__ import annotations

from geostrata.llm import bpe_automaton, embedding_dedup, language, licenses, merkle, minhash, neighbours, packing, periodic, quality, secrets, substrings, token_files

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_language": language.op2_language,
    "op3_substrings": substrings.op3_substrings,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_token_files": token_files.op5_token_files,
    "op6_quality": quality.op6_quality,
    "op7_packing": packing.op7_packing,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_secrets": secrets.op9_secrets,
    "op10_bpe": bpe_automaton.op10_bpe,
    "op11_merkle": merkle.op11_merkle,
    "op12_periodic": periodic.op12_periodic,
    "op13_licenses": licenses.op13_licenses,
}
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
REACH = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, far) AS (SELECT a, a FROM both_ways UNION SELECT r.node, t.b FROM reach r JOIN both_ways t ON t.a = r.far),
component AS (SELECT node, min(far) AS c FROM reach GROUP BY node)"""

#: CRC-32 of the decimal digits of a number, bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
LEAF = "sha256(concat(" + ", ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + ", {}))"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for the operators that it expresses; the others learn a model, call a tokenizer or report positions of matches.
ORACLE_SQL = {
    "op1_minhash": f"""
WITH RECURSIVE split AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),{REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN component ON node = d.doc_id""",
    "op3_substrings": f"""
WITH split AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM split),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS seq FROM split WHERE len(w) >= 20),
late AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM late),
marked AS (SELECT words.doc_id, words.pos, word, gone.pos IS NOT NULL AS removed FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos),
counted AS (SELECT doc_id, count(*) AS n, count(*) FILTER (removed) AS r, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id""",
    "op8_embedding_dedup": f"""
WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.vec_id < q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.93),{REACH},
counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN component ON node = e.vec_id""",
    "op11_merkle": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {LEAF.format(FIELD.format("text"))} AS leaf,
    {LEAF.format(FIELD.format(LOWER))} AS lowered, {CRC.format("doc_id")} % 5 = 0 AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 16, n),
subroots AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1),
upper(lvl, pos, h, n) AS (
  SELECT 0, row_number() OVER (ORDER BY tree) - 1, subroot, count(*) OVER () FROM subroots
  UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM upper WHERE n > 1 GROUP BY lvl, pos // 16, n),
named AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS pos FROM subroots),
low AS (SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),
high AS (SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM upper a JOIN upper b ON a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),
climb(doc_id, tree, lvl, pos, h, proof) AS (
  SELECT doc_id, tree, 0, pos, CASE WHEN tampered THEN lowered ELSE leaf END, '' FROM placed
  UNION ALL SELECT doc_id, c.tree, c.lvl + 1, c.pos // 16, sha256(l || c.h || r), proof || l || r FROM climb c JOIN low ON low.tree = c.tree AND low.lvl = c.lvl AND low.pos = c.pos),
arrived AS (SELECT doc_id, named.pos, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM climb JOIN named ON named.tree = climb.tree GROUP BY ALL),
rise(doc_id, lvl, pos, h, proof) AS (
  SELECT doc_id, 0, pos, h, proof FROM arrived
  UNION ALL SELECT doc_id, c.lvl + 1, c.pos // 16, sha256(l || c.h || r), proof || l || r FROM rise c JOIN high ON high.lvl = c.lvl AND high.pos = c.pos),
folded AS (SELECT doc_id, arg_max(h, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM rise GROUP BY doc_id),
top AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT p.doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN folded f ON f.doc_id = p.doc_id, top""",
    "op12_periodic": f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {CRC.format("doc_id")} AS h FROM documents),
sized AS (SELECT doc_id, w, h % 10 = 0 AND len(w) > 0 AS loops, h // 10 AS g, len(w) AS n FROM split),
turned AS (SELECT doc_id, n, CASE WHEN loops THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE w END AS w FROM sized),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS pos FROM turned),
pairs AS (SELECT a.doc_id, a.pos, b.pos - a.pos AS q FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.pos > a.pos WHERE b.pos - a.pos <= a.n // 4),
islands AS (SELECT doc_id, q, min(pos) AS start, count(*) + q AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, q ORDER BY pos) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
listed AS (SELECT doc_id, count(*) AS n_runs, min(struct_pack(l := -length, s := start, p := period)) AS top, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS pos FROM runs),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) AS text FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos WHERE gone.pos IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, -top.l AS length, top.p AS period, 1000 * -top.l // top.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id""",
}
