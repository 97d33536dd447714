"""The queries of this subpackage: each runs one operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, divergence, fill_middle, language, line_dedup, mixing, neighbours, pieces, quality, simhash, token_counts, token_output, toxicity
from ledgerloom.llm.batches import remainder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predicted() -> list:
    return [F.col("score"), (F.col("score") >= 0.5).cast("int").alias("predicted")]


def held_out(folds: int, fold: int):
    return F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), label="toxic", folds=5, held_out=0)
    return toxicity.score(docs, model).select("doc_id", held_out(5, 0), *predicted())


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, PIECE_MODEL).select("doc_id", "n_tokens")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), label="quality", folds=3, held_out=1)
    return quality.score(docs, model).select("doc_id", held_out(3, 1), *predicted())


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nothing else runs beside it, so workers may spend some 200 MB on remembered pieces
    return token_output.token_table(table(spark, sf_dir, "documents"), BYTE_BPE, remember=900_000)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
place AS (SELECT item, w, least(len(w), {decontaminate.WINDOW}) AS k, unnest(generate_series(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1))) AS i FROM item WHERE len(w) > 0),
pattern AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS said FROM place),
doc AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
spot AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc, (SELECT DISTINCT k FROM pattern) WHERE len(w) >= k),
met AS (SELECT doc_id, i, k, item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS said FROM spot) JOIN pattern USING (k, said)),
hit AS (SELECT doc_id, count(DISTINCT word_at) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS word_at FROM met) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = line_dedup.remove_boilerplate(docs, text_col="text", site_col="source", sites=line_dedup.SITES)
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS own FROM lines),
spread AS (SELECT own FROM trimmed WHERE own <> '' GROUP BY own HAVING count(DISTINCT source) >= {line_dedup.SITES}),
marked AS (SELECT t.*, s.own IS NOT NULL AS gone FROM trimmed t LEFT JOIN spread s ON t.own = s.own)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM marked GROUP BY doc_id
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


FILL_MIDDLE_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS unit, sha256('42:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, len(unit) AS n, [CAST('0x' || substr(h, i, 8) AS BIGINT) FOR i IN [1, 9, 17, 25]] AS d FROM doc),
cut AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
part AS (SELECT *, array_to_string(unit[1:a], '') AS pre, array_to_string(unit[a + 1:b], '') AS mid, array_to_string(unit[b + 1:], '') AS suf FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS DOUBLE) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS DOUBLE) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM part
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
met AS (SELECT row, lang, source, unnest(words) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS whole FROM met GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.LEAST_DOCUMENTS}),
language AS (SELECT lang, count(*) AS terms, sum(whole) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
cell AS (SELECT lang, source, term, count(*) AS n FROM met SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT lang, source, sum(n) AS total FROM cell GROUP BY lang, source),
full_cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST({divergence.UNIT} AS HUGEINT) * (coalesce(c.n, 0) + {divergence.SMOOTHING}) // (coalesce(o.total, 0) + {divergence.SMOOTHING} * l.terms) AS p,
    1 + CAST({divergence.UNIT} AS HUGEINT) * (k.whole + {divergence.SMOOTHING}) // (l.total + {divergence.SMOOTHING} * l.terms) AS q
  FROM grp g JOIN kept k USING (lang) JOIN language l USING (lang) LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM full_cell x JOIN full_cell y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
found AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM full_cell WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.ids_digest(pieces.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_nearest_neighbours, op2_toxicity, op3_simhash_near_dedup, op4_token_counts, op5_quality,
        op6_token_ids, op7_decontaminate, op8_line_dedup, op9_language, op10_mix_sources, op11_fill_middle, op12_source_divergence, op13_pieces,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_decontaminate": DECONTAMINATE_SQL, "op8_line_dedup": LINE_DEDUP_SQL, "op11_fill_middle": FILL_MIDDLE_SQL, "op12_source_divergence": DIVERGENCE_SQL}
