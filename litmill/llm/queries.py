"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import kneser_ney, langid, line_crf, ppm
from .bpe import encoded, read_vocabulary
from .centroids import CENTROIDS, ROUNDS, SCALE, WIDTH, clustered
from .lattice import near_duplicates
from .license_scan import EQUIVALENT, KNOWN, scanned
from .ngram_join import ngram_components
from .runs import periodic_runs
from .sample import sample_of
from .session import table
from .toxicity import SAMPLE, learn, toxicity
from .urlfilter import BLOCKED, RULES, filtered
from .winnow import contamination


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_bpe_codec(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"), read_vocabulary(vocabulary_path()))


def vocabulary_path() -> str:
    """The public vocabulary file; it stays where the box has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_winnowing_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A score from which a document is called toxic, or good.
CALL = 0.3


def toxicity_of(spark, sf_dir, docs):
    """docs with score and predicted; learned from labels outside the held-out fold."""
    everything = table(spark, sf_dir, "documents")
    model = learn(everything, sample_of(table(spark, sf_dir, "labels"), "toxic", 4, 2, SAMPLE))
    return toxicity(docs, model).withColumn("predicted", (F.col("score") >= CALL).cast("int"))


def _fold(by: int, left_out: int):
    """Whether a document is held out; one without a doc_id is, as nothing learns from it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % by == left_out, F.lit(True)).alias("held_out")


def op3_ppm_scores(spark, sf_dir):
    return ppm.scored(table(spark, sf_dir, "documents"), stable=True)


def op4_hierarchical_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.identified(docs, langid.learn(docs, 3, 1))
    return found.select("doc_id", _fold(3, 1), "lang_pred", "score")


def quality_of(spark, sf_dir, docs):
    """docs with score and predicted; learned from labels outside the held-out fold."""
    everything = table(spark, sf_dir, "documents")
    model = line_crf.learn(everything, sample_of(table(spark, sf_dir, "labels"), "quality", 5, 0, line_crf.SAMPLE))
    return line_crf.quality(docs, model).withColumn("predicted", (F.col("score") >= CALL).cast("int"))


def op5_line_crf_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_of(spark, sf_dir, docs).select("doc_id", _fold(5, 0), "score", "predicted")


def op6_e8_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op8_license_digests(spark, sf_dir):
    return scanned(table(spark, sf_dir, "documents"))


def op9_sorted_digest_urls(spark, sf_dir):
    return filtered(spark, table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_ftrl_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_of(spark, sf_dir, docs).select("doc_id", _fold(4, 2), "score", "predicted")


def op11_kneser_ney_rules(spark, sf_dir):
    return kneser_ney.judged(table(spark, sf_dir, "documents"), stable=True)


def op12_dyadic_square_runs(spark, sf_dir):
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=True)


def op13_vantage_point_clusters(spark, sf_dir):
    return clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_ppm_scores": op3_ppm_scores,
    "op4_hierarchical_langid": op4_hierarchical_langid,
    "op5_line_crf_quality": op5_line_crf_quality,
    "op6_e8_near_duplicates": op6_e8_near_duplicates,
    "op7_winnowing_decontamination": op7_winnowing_decontamination,
    "op8_license_digests": op8_license_digests,
    "op9_sorted_digest_urls": op9_sorted_digest_urls,
    "op10_ftrl_toxicity": op10_ftrl_toxicity,
    "op11_kneser_ney_rules": op11_kneser_ney_rules,
    "op12_dyadic_square_runs": op12_dyadic_square_runs,
    "op13_vantage_point_clusters": op13_vantage_point_clusters,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_LISTED = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED)
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0] + r[1]))

def _canonical(text: str) -> str:
    t = f"regexp_replace(replace(replace(lower(coalesce({text}, '')), '(c)', ' copyright '), '©', ' copyright '), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for a, b in EQUIVALENT:
        t = f"replace({t}, '{a}', '{b}')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^copyright( copyright)? [0-9]') AND x <> 'all rights reserved')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cluster_rounds() -> str:
    """The rounds of op13, each as an assignment and the means of it."""
    apart = "list_sum(list_transform(list_zip(k.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = []
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT row, k.q AS q, min([CAST({apart} AS BIGINT), c.c]) AS best FROM k, c{r} c GROUP BY row, k.q)")
        if r < ROUNDS:
            parts.append(f"""s{r} AS (SELECT c, pos, sum(x) AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM a{r}) GROUP BY 1, 2),
m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS q FROM s{r} GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (c))""")
    return ",\n".join(parts)


SQL: dict[str, str] = {
    "op13_vantage_point_clusters": f"""
WITH k AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS BIGINT) AS c, q FROM k ORDER BY c LIMIT {CENTROIDS}),
{_cluster_rounds()},
f AS (SELECT row, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance FROM a{ROUNDS}),
i AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM f GROUP BY 1)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM f) AS inertia,
       sha256(array_to_string((SELECT q FROM c{ROUNDS} WHERE c = cluster), ',')) AS centroid_sha256
FROM f JOIN k USING (row) JOIN i USING (cluster)""",
    "op8_license_digests": f"""
WITH known AS (SELECT array_to_string({_canonical("text")}, ' ') AS text, min(license) AS license
               FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}) AS k(license, text) GROUP BY 1),
d AS (SELECT doc_id, {_canonical("text")} AS lines FROM documents),
w AS (SELECT doc_id, license FROM d JOIN known ON array_to_string(lines, ' ') = text),
n AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices
      FROM (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, unnest(lines) AS text FROM d) JOIN known USING (text)) GROUP BY 1)
SELECT doc_id, license, coalesce(notices, '') AS notices FROM d LEFT JOIN w USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_sorted_digest_urls": rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} END AS rule,
       CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _BY_LENGTH)} WHEN {_LISTED} THEN 'block' ELSE 'allow' END AS verdict
FROM parts""",
    "op7_winnowing_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (SELECT DISTINCT least(len(w), 13) AS span FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, span, list_slice(w, s, s + span - 1) AS win
       FROM (SELECT item_id, w, least(len(w), 13) AS span, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, span, s, list_slice(w, s, s + span - 1) AS win
       FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM d, spans WHERE len(w) >= span)),
met AS (SELECT doc_id, item_id, s, span FROM dw JOIN iw USING (span, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + span)) AS p FROM met) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
}
