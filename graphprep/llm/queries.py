"""The queries of this subpackage: thin wrappers that apply an operator to its whole table and derive digest columns."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a class bigram model of the documents that are not held out."""
    from graphprep.llm.brown import train_and_score

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return train_and_score(_documents(spark, sf_dir), held_out)[0]


def op2_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines, as digests."""
    from graphprep.llm.linededup import dedup_lines

    kept = dedup_lines(_documents(spark, sf_dir), stats=True)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    from graphprep.llm.simhash import near_duplicates

    found = near_duplicates(_documents(spark, sf_dir), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of the ring, counts at most one apart."""
    from graphprep.llm.sharding import assign

    return assign(_documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids and back."""
    import public_tokenizers

    from graphprep.llm.bytebpe import decode, encode, read_ranks

    tokens = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = decode(encode(_documents(spark, sf_dir), tokens, public_tokenizers.PATTERN), tokens)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through a PNG column and back."""
    from graphprep.llm.media import read_media, with_media

    read = read_media(with_media(_documents(spark, sf_dir)), "doc_id")
    return read.select(
        F.col("key").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.lower(F.hex("phash")).alias("feature"),
    )


def op7_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in windows of 2048 tokens."""
    import public_tokenizers

    from graphprep.llm.packing import WINDOW, pack
    from graphprep.llm.wordbpe import token_pieces

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        pieces = token_pieces(_documents(spark, sf_dir), f.read(), WINDOW, with_ids=False)
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: The chain's categories in order, from the two labels that the tables have.
TOXICITY_LABELS = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_fluent": "toxic = 1 AND quality = 1"}


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", *[F.expr(c).alias(n) for n, c in TOXICITY_LABELS.items()])


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities and verdicts from a chain fitted on the labelled documents."""
    from graphprep.llm.toxicity import fit, predict

    docs = _documents(spark, sf_dir)
    chain = fit(docs, toxicity_labels(spark, sf_dir), list(TOXICITY_LABELS))
    return predict(docs, chain).drop("text")


def op9_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's links and component."""
    from graphprep.llm.neardup_vectors import near_duplicates

    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


#: Spark setting of the surrogates' key. Runs that are to give the same surrogates take it from a secret store.
SURROGATE_KEY = "spark.graphprep.surrogate.key"
_KEYS: dict[str, str] = {}


def surrogate_key(spark: SparkSession) -> str:
    """The key that is set, or one made at random for this application, which nobody can compute afterwards."""
    return spark.conf.get(SURROGATE_KEY, None) or _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with personal data replaced, and the number of replacements. Without a key in SURROGATE_KEY the surrogates differ
    from application to application."""
    from graphprep.llm.pii import replace_entities

    return replace_entities(_documents(spark, sf_dir), surrogate_key(spark), count="n_entities").select("doc_id", "n_entities", "text")


def op11_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 100 bytes, as digests."""
    from graphprep.llm.suffixes import remove_repeats

    left = remove_repeats(_documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its near words and forms."""
    from graphprep.llm.variants import DAMAGED, group_variants

    return group_variants(_documents(spark, sf_dir), DAMAGED)


def op13_bag_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's 50 best documents."""
    from graphprep.llm.ranking import rank_documents

    return rank_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_scores": op1_brown_scores,
    "op2_cuckoo_line_dedup": op2_cuckoo_line_dedup,
    "op3_golay_simhash": op3_golay_simhash,
    "op4_ring_sharding": op4_ring_sharding,
    "op5_two_tier_bpe": op5_two_tier_bpe,
    "op6_png_media": op6_png_media,
    "op7_linear_grouping": op7_linear_grouping,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_pca_tiles": op9_pca_tiles,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_bucket_refinement": op11_bucket_refinement,
    "op12_fm_variants": op12_fm_variants,
    "op13_bag_ranking": op13_bag_ranking,
}

#: Blanks of the line keys, and what lower-cases A-Z alone.
_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLE_SQL: dict[str, str] = {
    "op2_cuckoo_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
        ), keyed AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM lines),
        repeated AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.top AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op12_fm_variants": f"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), runs AS (
            SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
        ), counted AS (SELECT coalesce(id, '') AS id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY id, run),
        summed AS (
            SELECT run, k, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
                lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM counted, crc
        ), words AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM summed),
        v AS (SELECT word, sum(k)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
        pairs AS (
            SELECT a.word, b.word AS form, b.n AS form_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM v a JOIN cut b ON a.word = b.rest
            UNION SELECT b.word, a.word, a.n FROM v a JOIN cut b ON a.word = b.rest
        ), ordered AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY form_n DESC, form) AS turn, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
        led AS (SELECT v.word, v.n, coalesce(o.n_near, 0) AS n_near, CASE WHEN o.form_n >= 2 * v.n THEN o.form END AS form, CASE WHEN o.form_n >= 2 * v.n THEN o.form_n END AS form_n
            FROM v LEFT JOIN ordered o ON v.word = o.word AND o.turn = 1),
        chain AS (SELECT word, word AS root FROM led UNION ALL SELECT c.word, l.form FROM chain c JOIN led l ON c.root = l.word WHERE l.form IS NOT NULL),
        ends AS (SELECT c.word, c.root FROM chain c JOIN led l ON c.root = l.word WHERE l.form IS NULL)
        SELECT led.word, led.form, ends.root, led.n, led.n_near, led.form_n FROM led JOIN ends ON led.word = ends.word
    """,
    "op13_bag_ranking": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_TERM}) AS terms FROM documents),
        c AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
        q AS (SELECT item_id, list_distinct(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_TERM})) AS terms FROM benchmark),
        i AS (SELECT DISTINCT item_id, unnest(terms) AS term FROM q),
        f AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM f GROUP BY doc_id, n, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
        s AS (SELECT i.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * c.n_docs) // c.n_terms)))) AS score
            FROM i JOIN tf USING (term) JOIN w USING (term), c GROUP BY i.item_id, tf.doc_id),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 50
    """,
    "op9_pca_tiles": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id
    """,
}
