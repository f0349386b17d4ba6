"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.llm import collocations, ctw, decontam, langid, neardup, packing, pseudonyms, quality, repair, repeats, sharding, toxicity, warc
from cardlake.llm.common import cut, scratch, table

#: Labels (two numbers a row) go to the texts up to this many rows; beyond, both are shuffled.
BROADCAST_LABELS = 2_000_000


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return placed.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    measured = cut(quality.features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality")
    return quality.judge(measured, quality.fit(measured)).select(*base, "kept", "quality")


def op4_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    prototypes = langid.learn(docs.filter(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), pseudonyms.session_key(spark))
    return found.select("doc_id", "text", "n_pii", *[f"n_{k}" for k in pseudonyms.KINDS])


def op6_subsequence_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter("toxic is not null")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels
    model = toxicity.learn(docs.filter(~F.col("held_out")).join(labels, "doc_id"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *repeats.RESULTS)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.with_all(repair.digest(repair.repair(repair.damage(rows))), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_histogram_sharding, op3_quality_rules, op4_hyperdimensional_language, op5_feistel_pseudonyms,
              op6_subsequence_kernel_toxicity, op7_context_tree_weighting, op8_cost_packing, op9_warc_dictionary, op10_bagminhash, op11_suffix_array_dedup, op12_phrase_collocations, op13_conversation_repair)
}

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The other results rest on models, signatures, keyed permutations, tokenizers or hashes that SQL can't express; tests hold those against brute force.
ORACLE: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
starts AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, len(ws[i:i + 12]) AS size, array_to_string(ws[i:i + 12], ' ') AS w FROM starts),
places AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
runs AS (SELECT r, i, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM places, (SELECT DISTINCT size FROM win) WHERE i + size - 1 <= len(ws)),
hit AS (SELECT DISTINCT r, i, runs.size, item_id FROM runs JOIN win ON runs.w = win.w AND runs.size = win.size),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op9_warc_dictionary": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN first > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first > page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest""",
    "op10_bagminhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM places),
n AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id, s) AS nth FROM s),
t AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM n AS a JOIN n AS b ON a.s = b.s AND a.nth = b.nth AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN t AS ta ON ta.doc_id = a JOIN t AS tb ON tb.doc_id = b WHERE 5 * shared.c >= 4 * (ta.c + tb.c - shared.c)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a""",
    "op11_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT id, unnest(range(0, len(h) // 2 - 399)) AS i FROM d),
s AS (SELECT id, i, md5(substring(h, 2 * i + 1, 800)) AS s FROM p JOIN d USING (id)),
twice AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
hit AS (SELECT id, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM s JOIN twice USING (s)),
runs AS (SELECT id, min(i) AS a, max(i) + 400 AS b FROM hit GROUP BY id, run),
fresh AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY id ORDER BY a) THEN 0 ELSE 1 END AS new FROM runs),
spans AS (SELECT id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY a) AS g FROM fresh) GROUP BY id, g),
kept AS (SELECT d.id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS rest
         FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY id ORDER BY a), 0) AS prev FROM spans) AS s JOIN d USING (id) GROUP BY d.id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (id)""",
    "op12_phrase_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
halves AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM c, (SELECT unnest([1, 2]) AS j) WHERE j < k),
cuts AS (SELECT h.*, l.f AS l, x.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * x.f))::BIGINT AS score FROM halves AS h JOIN g AS l ON l.lang = h.lang AND l.phrase = lp JOIN g AS x ON x.lang = h.lang AND x.phrase = rp),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longest USING (lang, phrase) WHERE low.k = 3 OR coalesce(100 * longer < 50 * low.a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_conversation_repair": r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(k, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS kind FROM src),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE kind <> 0),
ord AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, role[1] AS o, CASE WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS x FROM ord),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (i > 1 AND before[1] || o NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
v AS (SELECT conv_id, n + 1 AS i, {c: 0, a: '', t: []::VARCHAR[]} AS v0, {c: 6, a: 'II', t: ['user:', 'assistant:']} AS v1, {c: 3, a: 'I', t: ['assistant:']} AS v2, {c: 0, a: '', t: []::VARCHAR[]} AS v3 FROM told
UNION ALL SELECT conv_id, i, list_min([b0, {c: b2.c + 3, a: 'I' || b2.a, t: list_prepend('user:', b2.t)}, {c: b3.c + 6, a: 'II' || b3.a, t: ['user:', 'assistant:'] || b3.t}]),
  list_min([b1, {c: b2.c + 3, a: 'I' || b2.a, t: list_prepend('user:', b2.t)}, {c: b3.c + 6, a: 'II' || b3.a, t: ['user:', 'assistant:'] || b3.t}]),
  list_min([b2, {c: b3.c + 3, a: 'I' || b3.a, t: list_prepend('assistant:', b3.t)}]), list_min([b3, {c: b2.c + 3, a: 'I' || b2.a, t: list_prepend('user:', b2.t)}])
  FROM (SELECT conv_id, i,
    list_min([d0, CASE WHEN ok AND o = 's' THEN {c: v1.c + x, a: 'K' || v1.a, t: list_prepend(y, v1.t)} WHEN ok AND o = 'u' THEN ku END, ru]) AS b0,
    list_min([d1, CASE WHEN ok AND o = 'u' THEN ku END, ru]) AS b1,
    list_min([d2, CASE WHEN ok AND o = 'a' THEN {c: v3.c + x, a: 'K' || v3.a, t: list_prepend(y, v3.t)} END, CASE WHEN ok THEN {c: v3.c + x + 3, a: 'R' || v3.a, t: list_prepend('assistant:' || text, v3.t)} END]) AS b2,
    list_min([d3, CASE WHEN ok AND o = 'u' THEN ku END, ru]) AS b3
    FROM (SELECT v.conv_id, f.i, v0, v1, v2, v3, f.o, f.x, f.text, f.role || ':' || f.text AS y, f.fault IN (0, 3) AS ok, {c: v0.c + 4, a: 'D' || v0.a, t: v0.t} AS d0, {c: v1.c + 4, a: 'D' || v1.a, t: v1.t} AS d1, {c: v2.c + 4, a: 'D' || v2.a, t: v2.t} AS d2, {c: v3.c + 4, a: 'D' || v3.a, t: v3.t} AS d3,
          {c: v2.c + f.x, a: 'K' || v2.a, t: list_prepend(f.role || ':' || f.text, v2.t)} AS ku, CASE WHEN f.fault IN (0, 3) THEN {c: v2.c + f.x + 3, a: 'R' || v2.a, t: list_prepend('user:' || f.text, v2.t)} END AS ru
          FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i - 1) AS e) AS s)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 1""",
}
