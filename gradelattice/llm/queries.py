"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelattice.llm import bpe, collocations, decontaminate, embedding_dedup, html_text, language_id, minhash, pieces, pii, quality_crf, suffix_dedup, token_files, vector_codes


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf, "documents")))


def op5_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf, "embeddings"))


def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, count_into="n_entities").select("doc_id", "text", "n_entities")


def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                             end_id=1, by_words=True)
    return token_files.read_documents(manifest)


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    identifier = language_id.fit(docs, _remainder(3) != 1)
    found = language_id.identify(docs.select("doc_id", "text"), identifier)
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                        F.col("lang_accepted").alias("accepted"), F.col("lang_bits").alias("bits"))


def op2_quality_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = quality_crf.fit(docs, _table(spark, sf, "labels"), _remainder(5) != 0)
    return (quality_crf.score(docs.select("doc_id", "text"), model)
            .select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")))


def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination_digest(decontaminate.find_copies(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")))


def op8_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf, "documents"), words=2, percent=80)


def op9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    model = pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(_table(spark, sf, "documents").select("doc_id", "text"), model, check_into="round_trip")
    return encoded.select("doc_id", "n_pieces", "n_bytes", "ids", "round_trip")


def op10_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(_table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf, "documents"))


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded = vector_codes.with_label_error(vector_codes.compress(_table(spark, sf, "embeddings").select("vec_id", "label", "embedding")))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return bpe.digest(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality_crf": op2_quality_crf,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_pii": op6_pii,
    "op7_token_files": op7_token_files,
    "op8_minhash": op8_minhash,
    "op9_pieces": op9_pieces,
    "op10_html_text": op10_html_text,
    "op11_collocations": op11_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_bpe": op13_bpe,
}

# DuckDB forms, for the operators that SQL can express.
WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ROUND_SQL = """
        a{k} AS MATERIALIZED (SELECT vec_id, p.part, min(64 * ((p.x - b.x) ^ 2 + (p.y - b.y) ^ 2 + (p.z - b.z) ^ 2 + (p.w - b.w) ^ 2)::BIGINT + entry) AS best
               FROM p JOIN b{k} b ON p.part = b.part GROUP BY ALL),"""
_MEANS_SQL = """
        b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x, coalesce(m.y, b.y) AS y, coalesce(m.z, b.z) AS z, coalesce(m.w, b.w) AS w
               FROM b{k} b LEFT JOIN (SELECT part, best % 64 AS entry, floor(sum(x) / count(*))::BIGINT AS x, floor(sum(y) / count(*))::BIGINT AS y,
                                             floor(sum(z) / count(*))::BIGINT AS z, floor(sum(w) / count(*))::BIGINT AS w
                                      FROM a{k} JOIN p USING (vec_id, part) GROUP BY ALL) m USING (part, entry)),"""

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS name, coalesce({WORDS_SQL}, []) AS w FROM benchmark),
        iw AS (SELECT DISTINCT name, least(10, len(w)) AS size, list_slice(w, k, k + least(10, len(w)) - 1) AS g
               FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM iw),
        dw AS (SELECT doc_id, size, k, list_slice(w, k, k + size - 1) AS g
               FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
        hit AS (SELECT doc_id, dw.size, k, name FROM dw JOIN iw ON dw.size = iw.size AND dw.g = iw.g),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY doc_id),
        named AS (SELECT doc_id, list_sort(list(DISTINCT name)) AS names FROM hit GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(len(names), 0) AS BIGINT) AS n_items,
               sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        g AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS k FROM d WHERE len(h) >= 100)),
        f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
        hit AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM g JOIN f USING (g) WHERE first < doc_id),
        run AS (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM hit),
        span AS (SELECT doc_id, r, min(k) AS a, max(k) + 50 AS b FROM run GROUP BY doc_id, r),
        spans AS (SELECT doc_id, list(a ORDER BY a) AS s, list(b ORDER BY a) AS e FROM span GROUP BY doc_id),
        joined AS (SELECT doc_id, h, coalesce(s, []) AS s, coalesce(e, []) AS e FROM d LEFT JOIN spans USING (doc_id))
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(e), 0) - coalesce(list_sum(s), 0) AS BIGINT) AS n_removed,
               CAST(len(s) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(array_to_string(list_transform(range(0, len(s) + 1), lambda i: substr(h,
                   2 * coalesce(e[i], 0) + 1, 2 * (coalesce(s[i + 1], len(h) // 2) - coalesce(e[i], 0)))), ''), ''))) AS kept_sha256
        FROM joined""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id)""",
    "op11_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        f AS MATERIALIZED (SELECT lang, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS phrase, count(*) AS n
              FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM w, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size)
              GROUP BY ALL),
        c AS MATERIALIZED (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND n >= 30),
        cut AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS p, array_to_string(list_slice(w, k + 1, size), ' ') AS q
                FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
        scored AS (SELECT cut.lang, cut.phrase, a, k, x.n AS l, y.n AS r, (2000000::HUGEINT * a) // (x.n + y.n) AS score
                   FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = p AND x.size = k
                            JOIN f y ON y.lang = cut.lang AND y.phrase = q),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, a, array_to_string(list_slice(w, k, k + s - 1), ' ') AS phrase
                   FROM (SELECT *, unnest(range(1, size - s + 2)) AS k FROM (SELECT *, unnest(range(2, size)) AS s FROM c))),
        longer AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
        kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
        total AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang)
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000""",
    "op12_vector_codes": """
        WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS c FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        p AS MATERIALIZED (SELECT vec_id, part, c[4 * part + 1] AS x, c[4 * part + 2] AS y, c[4 * part + 3] AS z, c[4 * part + 4] AS w
              FROM (SELECT vec_id, c, unnest(range(0, 16)) AS part FROM v)),
        b0 AS MATERIALIZED (SELECT part, entry, x, y, z, w FROM p
              JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) USING (vec_id) WHERE entry < 64),"""
        + _ROUND_SQL.format(k=0) + _MEANS_SQL.format(k=0, n=1) + _ROUND_SQL.format(k=1) + _MEANS_SQL.format(k=1, n=2) + _ROUND_SQL.format(k=2) + """
        coded AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
        books AS (SELECT sha256(string_agg(concat_ws(',', x, y, z, w), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM coded JOIN v USING (vec_id), books""",
    "op8_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS k FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        sides AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a)
        SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
        FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
}
