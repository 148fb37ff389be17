"""The registered queries: each applies one operator, with its production parameters, to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbatch.llm import bpe, exact_dedup, language, leaks, main_text, manifest, near_join, packing, quality, secrets, spelling, token_counts, topk
from docbatch.llm.common import table


def remainder(modulus: int) -> F.Column:
    """The fold of a document: the CRC-32 of its id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    """Learns only from labels outside the held-out fold."""
    return quality.fit(docs, labels.filter(remainder(5) != 0))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(remainder(3) != 1))
    return language.predict(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(50)) == 0, k=5)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents"))


def op9_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_manifest(table(spark, sf_dir, "documents"), tampered=remainder(7) == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(table(spark, sf_dir, "documents"))


def op13_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), leaks.item_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_main_text": op4_main_text,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_topk": op6_topk,
    "op7_secret_scan": op7_secret_scan,
    "op8_near_join": op8_near_join,
    "op9_bpe_encode": op9_bpe_encode,
    "op10_token_counts": op10_token_counts,
    "op11_manifest": op11_manifest,
    "op12_spelling": op12_spelling,
    "op13_leaks": op13_leaks,
}


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8."""
    octets = f"list_transform(generate_series(1, octet_length(encode({text}))::BIGINT), lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::BIGINT, 2))::BIGINT)"
    bits = "list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, c: {bits}), 4294967295)"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_of(text: str) -> str:
    """SQL of the words of a text, as decontamination takes them."""
    return f"regexp_extract_all({_LOWER.format(f"coalesce({text}, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


_FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in manifest.FIELDS)

ORACLES: dict[str, str] = {
    "op6_topk": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), scored AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.own <> c.own AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
    "op5_exact_dedup": """
        WITH plain AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
        ), ranked AS (
            SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS r,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM plain
        )
        SELECT doc_id, keep_id, group_size, r = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
    """,
    "op11_manifest": f"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS own, *, {_crc32("coalesce(doc_id::VARCHAR, '')")} % 7 = 0 AND doc_id IS NOT NULL AS tampered FROM documents
        ), digests AS (
            SELECT *, sha256({_FIELDS}) AS leaf,
                   CASE WHEN tampered AND n_chars IS NOT NULL THEN sha256({_FIELDS.replace("n_chars", "(n_chars + 1)")}) ELSE sha256({_FIELDS}) END AS changed
            FROM docs
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS total FROM digests
        ), nodes AS (
            SELECT lang, 0 AS level, place, total, leaf AS digest FROM placed
            UNION ALL
            SELECT lang, any_value(level) + 1, place // 2, (any_value(total) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
            FROM nodes WHERE total > 1 GROUP BY lang, place // 2
        ), subroots AS (
            SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE total = 1
        ), tops AS (
            SELECT 0 AS level, place, total, subroot AS digest FROM subroots
            UNION ALL
            SELECT any_value(level) + 1, place // 2, (any_value(total) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE total > 1 GROUP BY place // 2
        ), steps AS (
            SELECT p.own, n.level, (p.place >> n.level) % 2 AS side, o.digest AS other
            FROM placed p JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.total > 1 AND n.place = p.place >> n.level
            LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM p.lang AND o.level = n.level AND o.place = xor(n.place, 1)
            UNION ALL
            SELECT p.own, 100 + n.level, (s.place >> n.level) % 2, o.digest
            FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN tops n ON n.total > 1 AND n.place = s.place >> n.level
            LEFT JOIN tops o ON o.level = n.level AND o.place = xor(n.place, 1)
        ), paths AS (
            SELECT own, coalesce(string_agg(other, '' ORDER BY level), '') AS proof,
                   list(CASE WHEN other IS NULL THEN 'n' WHEN side = 1 THEN 'l' || other ELSE 'r' || other END ORDER BY level) AS path
            FROM steps GROUP BY own
        ), folded AS (
            SELECT p.*, sha256(coalesce(proof, '')) AS proof_sha256, (SELECT digest FROM tops WHERE total = 1) AS root,
                   list_reduce(list_prepend(changed, coalesce(path, [])), lambda d, x: sha256(CASE x[1] WHEN 'l' THEN x[2:] || d WHEN 'r' THEN d || x[2:] ELSE d END)) AS folded_root
            FROM placed p LEFT JOIN paths USING (own)
        )
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
        FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang
    """,
    "op12_spelling": f"""
        WITH RECURSIVE found AS (
            SELECT row_number() OVER () AS own, doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS raw FROM documents
        ), runs AS (
            SELECT own, any_value(doc_id) AS doc_id, {_LOWER.format("raw")} AS run, count(*) AS n FROM found WHERE length(raw) >= 7 GROUP BY own, run
        ), hashed AS (
            SELECT *, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs
        ), words AS (
            SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
        ), cut AS (
            SELECT word, n, i, left(word, i) || substr(word, i + 2) AS part FROM words, unnest(generate_series(0, length(word) - 1)) t(i)
        ), near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.part = b.part AND a.word <> b.word AND length(a.word) = length(b.word)
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.part = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.part = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
        ), formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
            FROM words w LEFT JOIN best USING (word)
        ), followed AS (
            SELECT word, word AS root FROM formed UNION ALL SELECT f.word, g.form FROM followed f JOIN formed g ON f.root = g.word WHERE g.form IS NOT NULL
        )
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
        FROM formed f JOIN followed r USING (word) JOIN formed l ON l.word = r.root AND l.form IS NULL
    """,
    "op13_leaks": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS own, doc_id, {_words_of("text")} AS w FROM documents
        ), items AS (
            SELECT item_id, {_words_of("text")} AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS part
            FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) t(i) WHERE len(w) > 0
        ), parts AS (
            SELECT own, k, i, array_to_string(w[i : i + k - 1], ' ') AS part
            FROM docs, (SELECT DISTINCT k FROM windows), unnest(generate_series(1, len(w) - k + 1)) t(i)
        ), hits AS (
            SELECT own, k, i, item_id FROM parts JOIN windows USING (k, part)
        ), words AS (
            SELECT own, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT own, k, i FROM hits), unnest(generate_series(0, k - 1)) t(j) GROUP BY own
        ), found AS (
            SELECT own, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR) FILTER (item_id IS NOT NULL)), ',') AS names FROM hits GROUP BY own
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM docs LEFT JOIN words USING (own) LEFT JOIN found USING (own)
    """,
}
