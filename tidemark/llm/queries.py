"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, class_lm, fill_middle, fingerprints, langid, license_scan, media, mixing, near_dedup, packing, spelling, token_ledger
from .common import read, shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]

#: The rank file of the installed public tokenizers that op3 uses.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The tokenizer of op13.
PACKED = "word_bpe_49k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.license_scan(read(spark, sf_dir, "documents")))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.digest(read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger's life over all documents: totals by source, language and tokenizer version.

    Estimates (a quarter of n_chars) are inserted, then revised to exact counts; one tokenizer version is inserted and
    wholly deleted, others inserted; every batch is sent twice, as after a lost acknowledgement, and batches are compacted
    in between.
    """
    rows = written(token_ledger.counts(read(spark, sf_dir, "documents"), "n_chars"), "token-counts")  # the texts are read once
    estimate = F.floor(F.coalesce(F.col("n_chars"), F.lit(0)) / 4)
    ledger = token_ledger.TokenLedger(spark, shared_dir(spark, "ledger"))
    batches = [
        ("1-estimates", token_ledger.inserts(token_ledger.counted(rows, "words-1", estimate))),
        ("2-exact", token_ledger.revisions(rows, "words-1", estimate)),
        ("3-alnum", token_ledger.inserts(token_ledger.counted(rows, "alnum-1"))),
        ("4-chars", token_ledger.inserts(token_ledger.counted(rows, "chars-1"))),
        ("5-bytes", token_ledger.inserts(token_ledger.counted(rows, "bytes-1"))),
        ("6-retire-alnum", token_ledger.deletes(token_ledger.counted(rows, "alnum-1"))),
    ]
    for _ in range(2):
        for batch_id, changes in batches:
            ledger.commit(batch_id, changes)
        ledger.compact()
    return ledger.totals()


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(read(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(read(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(read(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digest(read(spark, sf_dir, "documents"), public_tokenizers.path(PACKED))


def queries() -> dict[str, Query]:
    own = (
        op1_license_scan, op2_class_lm, op3_bpe, op4_fingerprints, op5_token_counts, op6_chat_format, op7_mixing, op8_near_dedup,
        op9_media, op10_language_id, op11_spelling, op12_fill_middle, op13_packing,
    )
    return {f.__name__: f for f in own}


_WORD_COUNT = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

_OP5 = f"""
SELECT source, lang, version, sum(documents)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM (
  SELECT source, lang, 'words-1' AS version, 1 AS documents, {_WORD_COUNT} AS tokens FROM documents
  UNION ALL SELECT source, lang, 'chars-1', 1, coalesce(length(text), 0) FROM documents
  UNION ALL SELECT source, lang, 'bytes-1', 1, coalesce(strlen(text), 0) FROM documents
) GROUP BY ALL"""

_OP6 = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), measured AS (
  SELECT *, length(role) + length(text) + 4 * (length(role || text) - length(replace(role || text, '&', '')))
    + 3 * (length(role || text) - length(replace(role || text, '<', '')))
    + 4 * (length(role || text) - length(replace(role || text, '[', '')))
    + 4 * (length(role || text) - length(replace(role || text, ']', ''))) + 12 AS formatted FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars
FROM measured GROUP BY conv_id"""

_OP7 = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, {_WORD_COUNT}::BIGINT AS size FROM documents
), each_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 1.5 * sum(source_size) OVER () AS budget FROM each_source
), level(step, value) AS (
  SELECT 0, (SELECT max(budget) / sum(weight) FROM weighed)
  UNION ALL
  SELECT step + 1, (SELECT (max(budget) - coalesce(sum(2.0 * source_size) FILTER (WHERE 2.0 * source_size < value * weight), 0))
    / sum(weight) FILTER (WHERE 2.0 * source_size >= value * weight) FROM weighed)
  FROM level WHERE step < (SELECT count(*) FROM weighed)
), targets AS (
  SELECT source, source_size, round(least(2.0 * source_size, weight * (SELECT max(value) FROM level)), 6)::DOUBLE AS target FROM weighed
), hashed AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT AS h, floor(ln(size + 1) * {mixing.STEPS})::BIGINT AS class FROM sized
), ranked AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY class, h % (SELECT greatest(1, ceil(count(*) / {mixing.GROUP_ROWS}.0))::BIGINT FROM sized), h, d.doc_id, d.size) AS place,
    ('0x' || substr(md5('offset:' || coalesce(t.source, '')), 1, 7))::BIGINT / 268435456.0::DOUBLE AS shift
  FROM hashed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (floor(place * rate + shift) - floor((place - 1) * rate + shift))::BIGINT * size AS taken FROM ranked"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op1() -> str:
    """Every place of every key phrase, by brute force; a notice counts where all its key phrases stand at their places."""
    rows = []
    for k, t in enumerate(license_scan.BASE + license_scan.EXTRA):
        own = t.notice.split()
        for phrase in t.keys:
            words = phrase.split()
            at = next(i for i in range(len(own)) if own[i : i + len(words)] == words)
            rows.append(f"({k}, '{t.label}', {str(t.base).lower()}, {len(t.keys)}, {own}, {at}, {words})")
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t(k, label, base, n_keys, notice, place, phrase) AS (VALUES {", ".join(rows)}),
p AS (SELECT w.doc_id, w.ws, t.*, i - place AS start FROM w, t, unnest(range(0, len(w.ws))) AS r(i) WHERE w.ws[i + 1] = phrase[1] AND w.ws[i + 1:i + len(phrase)] = phrase),
n AS (SELECT doc_id, k, any_value(label) AS label, any_value(base) AS base, start,
    any_value(list_sum(list_transform(range(0, len(notice)), lambda j: CASE WHEN start + j >= 0 AND ws[start + j + 1] = notice[j + 1] THEN 1 ELSE 0 END)) / len(notice)) AS score
  FROM p GROUP BY doc_id, k, start HAVING count(*) = any_value(n_keys))
SELECT w.doc_id, len(ws)::BIGINT AS n_words, count(*) FILTER (WHERE base)::BIGINT AS n_base, min(start) FILTER (WHERE base)::BIGINT AS first_word, max(start) FILTER (WHERE base)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0)::DOUBLE AS score
FROM w LEFT JOIN n ON w.doc_id = n.doc_id GROUP BY w.doc_id, ws"""


_OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY ALL)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""


_OP11 = """
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM counted, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS r(i)),
longer AS (SELECT less.word AS a, words.word AS b FROM less JOIN words ON less.rest = words.word),
near AS (SELECT a, b FROM longer UNION SELECT b, a FROM longer UNION SELECT p.word, q.word FROM less p JOIN less q ON p.i = q.i AND p.rest = q.rest AND p.word <> q.word),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS n FROM near JOIN words ON b = word GROUP BY a),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * words.n THEN b END AS form, CASE WHEN best.n >= 5 * words.n THEN best.n END AS form_n FROM words LEFT JOIN best ON words.word = best.a),
chain(word, tip) AS (SELECT word, word FROM formed UNION SELECT chain.word, form FROM chain JOIN formed ON chain.tip = formed.word WHERE form IS NOT NULL)
SELECT formed.word, formed.form, chain.tip AS root, formed.n, formed.n_near::BIGINT AS n_near, formed.form_n FROM formed JOIN chain ON formed.word = chain.word JOIN formed e ON chain.tip = e.word AND e.form IS NULL"""

_OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, length(t) AS n, [('0x' || substr(x, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose results SQL can express."""
    return {
        "op1_license_scan": _op1(), "op5_token_counts": _OP5, "op6_chat_format": _OP6, "op7_mixing": _OP7, "op8_near_dedup": _OP8,
        "op11_spelling": _OP11, "op12_fill_middle": _OP12,
    }
