"""The opN queries over the driver's tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm.audit import document_flags, filter_audit
from marketweave.llm.embeddings import embedding_dedup
from marketweave.llm.exact import exact_dedup
from marketweave.llm.langmix import language_id
from marketweave.llm.minhash import near_dedup
from marketweave.llm.mixing import pareto_mix
from marketweave.llm.pieces import encode, load_model
from marketweave.llm.quality import grade, quality
from marketweave.llm.resample import target_resample
from marketweave.llm.substrings import remove_repeats
from marketweave.llm.tokenfiles import token_digest
from marketweave.llm.toxicity import toxicity
from marketweave.llm.wrappers import extract_html


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(_table(spark, sf_dir, "documents")).drop("source", "copies", "u")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), load_model(tokenizer_path()))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = _table(spark, sf_dir, "labels").select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality(_table(spark, sf_dir, "documents"), ratings)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=50).drop("kept")


def op7_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(_table(spark, sf_dir, "pages"))


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = document_flags(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit(flags, list("ABCDE"), ["good_lost", "toxic_lost"])


def op12_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_nn_descent": op3_nn_descent,
    "op4_quality_ordinal": op4_quality_ordinal,
    "op5_language_mixture": op5_language_mixture,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_html_wrappers": op7_html_wrappers,
    "op8_toxicity_cnn": op8_toxicity_cnn,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_target_resample": op12_target_resample,
    "op13_token_files": op13_token_files,
}

SQL: dict[str, str] = {
    "op10_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op9_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, 1 + CASE WHEN len(w) >= 4 THEN len(w) - 3 ELSE least(len(w), 1) END), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id != y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op3_nn_descent": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op6_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS p, h FROM d),
        x AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM w),
        m AS (SELECT s, min(doc_id) AS m FROM x GROUP BY s HAVING min(doc_id) != max(doc_id)),
        c AS (SELECT doc_id, p FROM x JOIN m USING (s) WHERE m < doc_id),
        i AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS new FROM c),
        j AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM i),
        r AS (SELECT doc_id, span, min(p) AS lo, max(p) + 50 AS hi FROM j GROUP BY ALL),
        q AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
        k AS (SELECT d.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept
              FROM q JOIN d USING (doc_id) GROUP BY d.doc_id)
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op1_pareto_mix": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   (('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
        o AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        l AS (SELECT max(level) AS level FROM o WHERE level <= cap / w),
        t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM l)) AS target FROM w),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e0 FROM t),
        e2 AS (SELECT *, CASE WHEN abs(e0 - round(e0)) < 1e-12 THEN round(e0) ELSE e0 END AS e FROM e),
        p AS (SELECT source, source_size, target, floor(e)::BIGINT AS certain, e - floor(e) AS p, (e - floor(e)) * source_size AS rest FROM e2),
        x0 AS (SELECT *, (1::BIGINT << ((length(bin(greatest(size, 1))) - 1) // 2))::DOUBLE AS x FROM d),
        k AS (SELECT source, list({'x': x, 'n': n} ORDER BY x) AS ks FROM (SELECT source, x, CAST(sum(size) AS DOUBLE) AS n FROM x0 GROUP BY source, x) GROUP BY source),
        h AS (SELECT p.source, ks, rest, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0 AS i FROM p JOIN k ON p.source IS NOT DISTINCT FROM k.source
              UNION ALL
              SELECT source, ks, rest, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, i + 1
              FROM (SELECT *, (lo + hi) / 2 AS mid,
                           list_reduce(list_prepend(0::DOUBLE, list_transform(ks, lambda c: c.n * ((lo + hi) / 2 / (1 - (lo + hi) / 2) * c.x / (1 + (lo + hi) / 2 / (1 - (lo + hi) / 2) * c.x)))), lambda s, v: s + v) < rest AS low
                    FROM h WHERE i < 60)),
        f AS (SELECT source, lo / (1 - lo) AS factor FROM h WHERE i = 60),
        r0 AS (SELECT x0.*, source_size, target, certain, p, rest, factor, (u / (1 - u)) / (factor * x) AS rank
               FROM x0 JOIN p ON x0.source IS NOT DISTINCT FROM p.source JOIN f ON x0.source IS NOT DISTINCT FROM f.source),
        r AS (SELECT *, CASE WHEN p > 0 AND factor > 0 THEN rank / (1 + rank) ELSE u END AS q FROM r0),
        c AS (SELECT *, p > 0 AND size > 0 AND sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS chosen FROM r),
        g AS (SELECT *, rest - sum(CASE WHEN chosen THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
        x AS (SELECT *, p > 0 AND size > 0 AND NOT chosen AND size < 2 * gap AS able FROM g),
        y AS (SELECT *, able AND row_number() OVER (PARTITION BY source, able ORDER BY abs(size - gap), q, doc_id) = 1 AS one FROM x)
        SELECT doc_id, size, source_size, target, CAST(size * (certain + CASE WHEN chosen OR one THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM y""",
    "op11_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
                     + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false)::INT AS m
              FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
        g AS (SELECT part, m, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY part, m),
        b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM b a JOIN b ON b.x != a.x JOIN b c ON c.x NOT IN (a.x, b.x) JOIN b d ON d.x NOT IN (a.x, b.x, c.x) JOIN b e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
        s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS x, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
                     list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS past FROM o, range(1, 6) r(step)),
        r AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (m & (coalesce(past, 0) | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (m & bit != 0 AND m & coalesce(past, 0) = 0), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (m & bit != 0 AND m & coalesce(past, 0) != 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (m = bit), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (m & bit != 0 AND m & coalesce(past, 0) = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (m & bit != 0 AND m & coalesce(past, 0) = 0), 0)::BIGINT AS toxic_lost
              FROM g, s GROUP BY part, filter_order, step, x)
        SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r""",
    "op12_target_resample": r"""
        WITH tb AS (SELECT list(c ORDER BY n) AS tb FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
        x AS (SELECT 0 AS k, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        w AS (SELECT k, doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
        f AS (SELECT k, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
        u AS (SELECT k, row, f, count(*) AS c FROM f GROUP BY ALL),
        h AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tb[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
              FROM (SELECT DISTINCT f FROM u), tb),
        c AS (SELECT bucket, coalesce(sum(c) FILTER (k = 0), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (k = 1), 0)::DOUBLE AS t FROM u JOIN h USING (f) GROUP BY bucket),
        z AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
        g AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM c, z),
        d AS (SELECT row, sum(c) AS n, sum(c * gain) AS total FROM u JOIN h USING (f) JOIN g USING (bucket) WHERE k = 0 GROUP BY row),
        v AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN d USING (row) WHERE k = 0),
        q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score, row_number() OVER () AS row FROM v),
        a AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, 25 * count(*) OVER () // 100 AS most FROM q WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM q LEFT JOIN a USING (row)""",
}
