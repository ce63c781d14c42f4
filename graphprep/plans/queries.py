"""Queries over the supplied tables and their DuckDB counterparts, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphprep.functions import text as T
from graphprep.operators import builders as B
from graphprep.operators import encode as E
from graphprep.operators import metrics as M
from graphprep.operators import rules as R
from graphprep.operators.kernels import sum_vectors
from graphprep.plans.examples import document_chains, pointed_chains, spread, table
from graphprep.schema import SIZE_BUCKETS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Parts of the DuckDB statements.
_ESC = "replace(replace(replace(replace({}, chr(92), chr(92)||chr(92)), chr(10), chr(92)||'n'), chr(9), chr(92)||'t'), chr(13), chr(92)||'r')"
_PCT = "(('0x'||substr(md5('{}:'||CAST({} AS VARCHAR)),1,8))::BIGINT % 100)"
_SPLIT = f"CASE WHEN {_PCT.format('split', 'doc_id')} < 80 THEN 'train' WHEN {_PCT.format('split', 'doc_id')} < 90 THEN 'valid' ELSE 'test' END"
_TOK = f"tok AS (SELECT doc_id, split, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {_SPLIT} AS split, string_split(text, ' ') AS w FROM documents)), lab AS (SELECT doc_id, split, pos, {_ESC.format('word')} AS label FROM tok)"
_OUT = "outs AS (SELECT doc_id, unnest(o) AS word, unnest(range(len(o))) AS pos FROM (SELECT doc_id, string_split(string_split(text, chr(10))[-1], ' ') AS o FROM documents))"
_VOCAB = f"cnt AS (SELECT label, count(*) AS c FROM lab WHERE split = 'train' GROUP BY 1), voc AS (SELECT label, row_number() OVER (ORDER BY c DESC, label) + 1 AS id FROM cnt WHERE label NOT IN ('<OOV>', '<pad>') QUALIFY row_number() OVER (ORDER BY c DESC, label) + 1 < 1000)"
_PT = "pt AS (SELECT c.conv_id, c.turn, string_split(c.text, ' ') AS p, string_split(n.text, ' ') AS t, c.text AS ptext, n.text AS ttext FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn = c.turn + 1)"
_RATIO = "CASE WHEN ({1}) = 0 THEN 0.0 ELSE CAST({0} AS DOUBLE) / ({1}) END"


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def counted(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
    """Register a query that SQL cannot express; tests hold it against another way of computing it."""
    QUERIES[f.__name__] = f
    return f


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, split, pos, word) of all documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("split", R.split_of(F.col("doc_id")))
    return docs.select("doc_id", "split", F.posexplode_outer(T.words(F.col("text"))).alias("pos", "word")).where("word is not null")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words as node labels."""
    return _words(spark, sf_dir).select("doc_id", "split", "pos", T.escape(F.col("word")).alias("token"))


def _label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (split, token, cnt). Words are counted first and escaped then, which keeps different ones different."""
    counts = _words(spark, sf_dir).groupBy("split", "word").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select("split", T.escape(F.col("word")).alias("token"), "cnt")


def _vocab(spark: SparkSession, sf_dir: str, most: int = 1000) -> DataFrame:
    return E.vocabulary(_label_counts(spark, sf_dir).where("split = 'train'").withColumn("kind", F.lit("node_label")), most)


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a prediction of the next: rows (conv_id, turn, p, t, ptext, ttext)."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ttext"))
    return c.withColumnRenamed("text", "ptext").join(n, ["conv_id", "turn"]).withColumns({"p": T.words(F.col("ptext")), "t": T.words(F.col("ttext"))})


# ---- frequencies, vocabularies, encoding


@query(f"WITH {_TOK} SELECT label AS token, count(*) AS cnt FROM lab GROUP BY 1 ORDER BY cnt DESC, token LIMIT 100")
def token_count_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_counts(spark, sf_dir).groupBy("token").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "token").limit(100)


@query(f"WITH {_TOK}, {_VOCAB} SELECT label AS token, id FROM voc UNION ALL VALUES ('<OOV>', 0), ('<pad>', 1)")
def vocab_with_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir).select("token", F.col("id").cast("bigint").alias("id"))


@query(f"WITH {_TOK}, {_VOCAB} SELECT split, count(*) AS n_tokens, count(*) FILTER (WHERE v.id IS NULL) AS n_oov FROM lab LEFT JOIN voc v ON lab.label = v.label GROUP BY split")
def encode_oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each split's labels by the vocabulary of train: different labels are looked up, their counts added."""
    found = E.lookup(_label_counts(spark, sf_dir), _vocab(spark, sf_dir), "node_label")
    return found.groupBy("split").agg(F.sum("cnt").alias("n_tokens"), F.sum(F.when(F.col("id") == 0, F.col("cnt")).otherwise(0)).alias("n_oov"))


@query("WITH w AS (SELECT item_id, string_split(text, ' ')[1] AS first, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM benchmark) SELECT item_id, 1 AS output, CAST(pos AS INTEGER) AS node FROM w WHERE word = first")
def copy_pairs_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy pairs of short outputs, without a shuffle."""
    found = pointed_chains(spark, sf_dir).select("item_id", F.explode(E.copy_pairs(F.col("output"), F.col("nodes.label"))).alias("p"))
    return found.select("item_id", "p.output", "p.node")


@query(f"WITH {_TOK}, {_OUT} SELECT o.doc_id, count(*) AS n_pairs, sum(o.pos)::BIGINT AS sum_output, sum(l.pos)::BIGINT AS sum_node FROM outs o JOIN lab l ON o.doc_id = l.doc_id AND o.word = l.label GROUP BY o.doc_id")
def copy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy pairs of long outputs, by a join in long form."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pairs = E.copy_pairs_of_words(docs, "doc_id", T.words(F.element_at(F.split("text", "\n", -1), -1)), T.words(F.col("text")))
    return pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("output").cast("bigint").alias("sum_output"), F.sum("node").cast("bigint").alias("sum_node"))


@query("SELECT item_id, 0 AS output, CAST(floor(len(string_split(text, ' ')) / 2) AS INTEGER) AS node FROM benchmark")
def pointer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointed_chains(spark, sf_dir).select("item_id", F.explode(E.pointer_pairs(F.col("output"))).alias("p")).select("item_id", "p.output", "p.node")


@query(f"SELECT item_id, 'POINTER(' || CAST(floor(len(string_split(text, ' ')) / 2) AS INTEGER) || ') ' || {_ESC.format("string_split(text, ' ')[1]")} || ' DONE' AS said FROM benchmark")
def output_linearise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointed_chains(spark, sf_dir).select("item_id", F.array_join(T.linearise(F.col("output"), with_ids=True), " ").alias("said"))


@query(f"""WITH {_TOK}, {_VOCAB}, {_OUT}, seen AS (SELECT DISTINCT doc_id, label FROM lab)
    SELECT o.doc_id, bool_and(v.id IS NOT NULL OR s.label IS NOT NULL) AS possible FROM outs o LEFT JOIN voc v ON o.word = v.label LEFT JOIN seen s ON s.doc_id = o.doc_id AND s.label = o.word GROUP BY o.doc_id""")
def impossible_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every output token of an example is in the vocabulary or among its node labels."""
    ex = document_chains(spark, sf_dir).select("doc_id", "nodes", F.filter("output", lambda o: o["kind"] == "token").alias("output"))
    ids = E.lookup(ex.select("doc_id", F.posexplode("output.token").alias("pos", "token")), _vocab(spark, sf_dir), "node_label")
    ids = ids.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    places = E.once(F.col("nodes.label"), lambda labels: F.filter(F.transform("output", lambda o, i: F.when(F.array_contains(labels, o["token"]), i)), lambda i: i.isNotNull()))
    copyable = ex.select("doc_id", places.alias("copyable"))
    return ids.join(copyable, "doc_id").select("doc_id", E.is_possible(F.col("ids"), F.col("copyable")).alias("possible"))


@query(f"WITH {_TOK} SELECT doc_id, CAST(max(pos) + 1 AS INTEGER) AS n_nodes, CAST(count(DISTINCT label) AS INTEGER) AS n_labels FROM lab GROUP BY doc_id")
def chain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chains(spark, sf_dir).select("doc_id", "n_nodes", F.size(F.array_distinct("nodes.label")).alias("n_labels"))


@query(f"""WITH {_TOK}, e AS (SELECT doc_id, pos AS src, pos + 1 AS dst, 'NEXT_TOKEN' AS type FROM lab l WHERE EXISTS (SELECT 1 FROM lab m WHERE m.doc_id = l.doc_id AND m.pos = l.pos + 1)),
    b AS (SELECT * FROM e UNION ALL SELECT doc_id, dst, src, 'REVERSED_' || type FROM e) SELECT type, count(*) AS n, sum(src)::BIGINT AS sum_src, sum(dst)::BIGINT AS sum_dst FROM b GROUP BY type""")
def chain_edges_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    e = B.chain_edge_rows(docs, "doc_id", F.size(T.words(F.col("text"))))
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("src").cast("bigint").alias("sum_src"), F.sum("dst").cast("bigint").alias("sum_dst"))


# ---- splits, statistics, dedup, sampling


@query(f"SELECT {_SPLIT} AS split, count(*) AS n FROM documents GROUP BY 1")
def md5_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(R.split_of(F.col("doc_id")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TOK}, s AS (SELECT doc_id, split, count(*) AS n FROM lab GROUP BY 1, 2) SELECT split, " + ", ".join(f"count(*) FILTER (WHERE n <= {k}) AS upto_{k}" for k in SIZE_BUCKETS) + " FROM s GROUP BY split")
def size_bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chains(spark, sf_dir).groupBy("split").agg(*[F.count_if(F.col("n_nodes") <= k).alias(f"upto_{k}") for k in SIZE_BUCKETS])


@query(f"""WITH {_TOK}, {_OUT}, s AS (SELECT doc_id, split, count(*) AS n FROM lab GROUP BY 1, 2), o AS (SELECT doc_id, count(*) AS k FROM outs GROUP BY 1)
    SELECT split, count(*) AS n_examples, CAST(coalesce(max(n), 0) AS INTEGER) AS max_nodes, CAST(coalesce(max(2 * (n - 1)), 0) AS INTEGER) AS max_edges, CAST(coalesce(max(k + 1), 0) AS INTEGER) AS max_output FROM s JOIN o USING (doc_id) GROUP BY split""")
def max_stats_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.max(c), F.lit(0))
    return document_chains(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_examples"), zero("n_nodes").alias("max_nodes"), zero("n_edges").alias("max_edges"), zero("n_output").alias("max_output"))


@query(f"SELECT doc_id, split FROM (SELECT doc_id, {_SPLIT} AS split, row_number() OVER (PARTITION BY text, source ORDER BY CASE {_SPLIT} WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, doc_id) AS r FROM documents) WHERE r = 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = R.content_hash(document_chains(spark, sf_dir)).select("doc_id", "split", "content_hash")
    return R.first_of_each(hashed, ["content_hash"], [R.split_rank(F.col("split")), F.col("doc_id")]).select("doc_id", "split")


@query("SELECT source, count(*) AS n, CAST(max(count(*)) OVER () AS DOUBLE) / count(*) AS weight FROM documents GROUP BY source")
def oversample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.crossJoin(F.broadcast(most)).select("source", "n", (F.col("most").cast("double") / F.col("n")).alias("weight"))  # one row


@query("SELECT event_type AS task, count(*) AS n, CAST(max(count(*)) OVER () AS DOUBLE) / count(*) AS weight FROM events GROUP BY event_type")
def task_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as tasks, each to be as large as the largest."""
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).select("task", "n", (F.col("most").cast("double") / F.col("n")).alias("weight"))  # one row


@query(f"""WITH w AS (SELECT lang, CAST(max(count(*)) OVER () AS DOUBLE) / count(*) AS weight FROM documents GROUP BY lang), d AS (SELECT d.lang, CAST(floor(weight) AS INTEGER) + CASE WHEN ('0x'||substr(md5('copies:'||CAST(doc_id AS VARCHAR)),1,13))::BIGINT < (weight - floor(weight)) * 4503599627370496 THEN 1 ELSE 0 END AS copies FROM documents d JOIN w ON d.lang = w.lang)
    SELECT lang, count(*) AS n_docs, sum(copies)::BIGINT AS n_rows FROM d GROUP BY lang""")
def oversample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    w = n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).select("lang", (F.col("most").cast("double") / F.col("n")).alias("weight"))
    rows = R.oversample(docs.join(w, "lang"), F.col("weight"), F.col("doc_id"))
    return rows.groupBy("lang").agg(F.count_if(F.col("copy") == 1).alias("n_docs"), F.count(F.lit(1)).alias("n_rows"))


@query(f"SELECT doc_id, split, CAST(floor((row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) / 32) AS BIGINT) AS batch FROM (SELECT doc_id, {_SPLIT} AS split FROM documents) QUALIFY count(*) OVER (PARTITION BY split) - ((row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) // 32) * 32 >= 32")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", R.split_of(F.col("doc_id")).alias("split"))
    return R.batches(rows, ["split"], "doc_id", 32, drop_remainder=True).select("doc_id", "split", "batch")


# ---- scalar functions


@query(f"SELECT doc_id, md5({_ESC.format('text')}) AS escaped FROM documents")
def escape_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.escape(F.col("text"))).alias("escaped"))


@query("SELECT doc_id, md5(array_to_string(list_concat(['[CLS]'], list_concat(string_split(text, ' ')[1:254], ['[SEP]'])), ' ')) AS kept FROM documents")
def prefix_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.truncate(T.words(F.col("text")), 256), " ")).alias("kept"))


@query(f"WITH {_PT} SELECT conv_id, turn, CAST(CASE WHEN a + b > 64 THEN least(a, greatest(64 - b, 32)) ELSE a END AS INTEGER) AS first_len, CAST(CASE WHEN a + b > 64 THEN 64 - least(a, greatest(64 - b, 32)) ELSE b END AS INTEGER) AS second_len FROM (SELECT conv_id, turn, len(p) AS a, len(t) AS b FROM pt)")
def pair_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = T.pair_lengths(F.size("p"), F.size("t"), 64)
    return _pred(spark, sf_dir).select("conv_id", "turn", a.alias("first_len"), b.alias("second_len"))


@query("SELECT item_id, CAST(greatest(128, len(w)) AS INTEGER) AS padded, CAST(greatest(128 - len(w), 0) AS INTEGER) AS n_pad FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def pad_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.pad(T.words(F.col("text")), 128, "<pad>")
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(p).alias("padded"), F.size(F.filter(p, lambda t: t == "<pad>")).alias("n_pad"))


@query("""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM benchmark), m AS (SELECT item_id, pos, count(*) OVER (PARTITION BY item_id, word) > 1 AS cand FROM w)
    SELECT item_id, string_agg(CASE WHEN cand THEN '1' ELSE '0' END, '' ORDER BY pos) AS mask FROM m GROUP BY item_id""")
def candidate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    repeated = lambda ws, t, _: F.size(F.filter(ws, lambda x: x == t)) > 1
    ex = B.repair_examples(items, T.words(F.col("text")), repeated, F.array(T.token(F.lit("NO_BUG"))))
    ids = F.transform(F.filter("nodes", lambda n: n["is_repair_candidate"]), lambda n: n["id"])
    return ex.select("item_id", F.array_join(E.mask(ids, F.size("nodes")), "").alias("mask"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN user_id % 1000 WHEN event_id % 5 = 2 THEN 1 ELSE NULL END::INTEGER AS at, CASE WHEN event_id % 5 = 3 AND user_id % 1000 <> 1 THEN user_id % 1000 WHEN event_id % 5 = 2 THEN 1 END::INTEGER AS location FROM events")
def pointer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id") % 5, (F.col("user_id") % 1000).cast("string")
    text = F.when(k == 0, "noise").when(k == 1, F.concat(F.lit("POINTER("), u, F.lit(",x) y"))).when(k == 2, F.lit("BUG_FREE")).when(k == 3, F.concat(F.lit("ERROR_LOCATION_"), u, F.lit(" z"))).otherwise(F.lit("POINTER(,)"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("s"))
    at = F.when(F.col("s") == "BUG_FREE", F.lit(1)).otherwise(T.parse_pointer(F.col("s")))
    return rows.select("event_id", at.alias("at"), T.parse_error_location(F.col("s")).alias("location"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_OPS = "CASE event_id % 5 WHEN 0 THEN 'add_node' WHEN 1 THEN 'del_node' WHEN 2 THEN 'replace_val' WHEN 3 THEN 'replace_type' ELSE 'NoOp' END"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.array(*map(F.lit, ("add_node", "del_node", "replace_val", "replace_type", "NoOp")))
    op = F.element_at(ops, (F.col("event_id") % 5 + 1).cast("int"))
    sep = F.lit("!#@$")
    script = F.when(op == "NoOp", op).when(op == "del_node", F.concat(op, sep, F.col("user_id").cast("string"))).otherwise(F.concat(op, sep, F.col("user_id").cast("string"), sep, F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", op.alias("op"), script.alias("script"))




@query("SELECT item_id, array_to_string(w[1:CAST(len(w) / 3 AS INTEGER)], ' ') AS kept FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def done_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("w")).withColumn("k", F.bround(F.size("w") / 3).cast("int"))
    said = F.concat(F.slice("w", F.lit(1), F.col("k")), F.array(F.lit("DONE")), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")))
    return w.select("item_id", F.array_join(T.cut_at(said), " ").alias("kept"))


# ---- joins and graph builders


@query("""WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT k, n, sum(n) OVER (ORDER BY k) - n AS start FROM n), r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i FROM lineitem)
    SELECT s.k AS graph, CAST(s.start AS BIGINT) AS start, count(*) AS n_rows, sum(r.l_partkey)::BIGINT AS sum_part FROM s JOIN r ON r.l_orderkey = s.k AND r.i >= s.start AND r.i < s.start + s.n GROUP BY 1, 2""")
def prefix_sum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each graph's rows begin in the flat row file: running sums by ranges of keys, so that no task sees all counts."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("graph")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_partkey").cast("bigint").alias("sum_part"))
    n = n.withColumn("part", F.floor(F.col("graph") / 4096))
    before = n.groupBy("part").agg(F.sum("n_rows").alias("rows")).withColumn("shift", F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("rows"))
    inside = F.sum("n_rows").over(Window.partitionBy("part").orderBy("graph")) - F.col("n_rows")
    return n.withColumn("inside", inside).join(before.select("part", "shift"), "part").select("graph", (F.col("shift") + F.col("inside")).cast("bigint").alias("start"), "n_rows", "sum_part")


@query("SELECT n.n_name AS type, r.r_name AS label, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2")
def id_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("n_name").alias("type"), F.col("r_name").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT CAST(floor(0.8 * max(o_orderkey)) AS BIGINT) AS a, CAST(floor(0.9 * max(o_orderkey)) AS BIGINT) AS b FROM orders) SELECT CASE WHEN o_orderkey <= a THEN 'train' WHEN o_orderkey <= b THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM orders, t GROUP BY 1")
def split_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    t = o.agg(*[F.floor(F.lit(x).cast("double") * F.max("o_orderkey")).alias(n) for x, n in ((0.8, "a"), (0.9, "b"))])
    split = F.when(F.col("o_orderkey") <= F.col("a"), "train").when(F.col("o_orderkey") <= F.col("b"), "valid").otherwise("test")
    return o.crossJoin(F.broadcast(t)).groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))  # one row of thresholds


@query("SELECT CASE WHEN l.toxic = 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def membership_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a list of members get its split; others drop out."""
    members = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "test").otherwise("train").alias("split"))
    return table(spark, sf_dir, "documents").select("doc_id").join(members, "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PT} SELECT conv_id, turn, md5(ptext) AS a, md5(ttext) AS b FROM pt")
def zip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pred(spark, sf_dir).select("conv_id", "turn", F.md5("ptext").alias("a"), F.md5("ttext").alias("b"))


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    path = F.struct(F.split("c_name", "#", -1).alias("start"), F.array("r_name", "n_name", "c_mktsegment").alias("ast"), F.split("c_mktsegment", "I", -1).alias("end"))
    return rows.select("c_custkey", B.path_nodes(F.array(path, path)).alias("nodes"))


@query("""WITH x AS (SELECT c_custkey, len(string_split(c_name, '#')) AS s, len(string_split(c_mktsegment, 'I')) AS e FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, CAST(1 + 2 * (s + 1 + 3 + e + 1 + 1) AS INTEGER) AS n_nodes, CAST(1 + s AS INTEGER) AS first_start, CAST(1 + 2 * (s + 6 + e) - 1 AS INTEGER) AS last_root FROM x""")
def path_forest_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda kind: F.transform(F.filter("nodes", lambda n: n["type"] == kind), lambda n: n["id"])
    return _forest(spark, sf_dir).select("c_custkey", F.size("nodes").alias("n_nodes"), F.element_at(at("START_TOKEN"), 1).alias("first_start"), F.element_at(at("ROOT_AST_PATH"), -1).alias("last_root"))



def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pred(spark, sf_dir)
    return B.tree_examples(rows, {"ASK": F.col("p"), "REPLY": F.col("t"), "TURN": F.array(F.col("turn").cast("string"))}, F.array(T.token(F.col("ttext"))))


@query(f"WITH {_PT} SELECT conv_id, turn, CAST(1 + len(p) + 1 + len(t) + 1 + 2 AS INTEGER) AS n_nodes, CAST(2 * ((len(p) - 1) + len(p) + 1 + (len(t) - 1) + len(t) + 1 + 0 + 1 + 1) AS INTEGER) AS n_edges FROM pt")
def three_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(spark, sf_dir).select("conv_id", "turn", "n_nodes", "n_edges")


@query(f"WITH {_PT} SELECT conv_id, turn, CAST(2 * ((CASE WHEN len(p) > 1 THEN 1 ELSE 0 END) + 2 + (CASE WHEN len(t) > 1 THEN 1 ELSE 0 END) + 2 + 2) AS INTEGER) AS n_edge_types FROM pt")
def edge_type_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(spark, sf_dir).select("conv_id", "turn", "n_edge_types")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS graph, l_linenumber AS dst FROM lineitem) SELECT o.o_orderkey AS graph, CAST(1 + count(e.dst) AS INTEGER) AS n_nodes, CAST(2 * count(e.dst) AS INTEGER) AS n_edges FROM orders o LEFT JOIN e ON e.graph = o.o_orderkey GROUP BY 1""")
def given_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as graph: the order is node 0, its lines are nodes 1 and up."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph"), F.lit("ORDER").alias("type"), F.col("o_orderstatus").alias("label"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("id"), F.lit("LINE").alias("type"), F.col("l_returnflag").alias("label"))
    return B.parent_graph(o, lines, "graph").select("graph", "n_nodes", "n_edges")


@query("""WITH e AS (SELECT DISTINCT l_partkey % 50 AS graph, l_suppkey AS dst, l_returnflag AS type FROM lineitem)
    SELECT graph, CAST(count(DISTINCT dst) AS INTEGER) AS n_nodes, CAST(2 * count(*) AS INTEGER) AS n_edges, CAST(2 * count(DISTINCT type) AS INTEGER) AS n_edge_types, sum(dst)::BIGINT AS ends FROM e GROUP BY graph""")
def given_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of given nodes and given edges that repeat: suppliers of parts, joined by what happened to a line."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("graph"), F.col("l_suppkey").alias("id"), F.lit("SUPPLIER").alias("type"), F.col("l_suppkey").cast("string").alias("label"), F.col("l_returnflag").alias("flag"))
    edges = lines.select("graph", F.lit(0).alias("src"), F.col("id").alias("dst"), F.col("flag").alias("type"))
    found = B.given_graph(lines.select("graph", "id", "type", "label").distinct(), edges, "graph")
    ends = F.aggregate(F.filter("edges", lambda e: ~F.startswith(e["type"], F.lit("REVERSED_"))), F.lit(0).cast("bigint"), lambda s, e: s + e["dst"])
    return found.select("graph", "n_nodes", "n_edges", "n_edge_types", ends.alias("ends"))


@query("""WITH d AS (SELECT doc_id % 5 AS k, len(string_split(text, ' ')) AS n FROM documents)
    SELECT rule, count(*) AS n FROM (SELECT unnest(CASE WHEN k = 0 THEN ['V5_edge_end'] WHEN k = 1 AND n > 1 THEN ['V7_repeated_edge'] WHEN k = 2 THEN ['V8_pointer_range'] WHEN k = 3 AND n > 2 THEN ['V3_repeated_id', 'V4_ids_not_contiguous'] ELSE ['none'] END) AS rule FROM d) GROUP BY 1""")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults planted by doc_id in the documents' chains must be found, and only those: an edge to nowhere, a repeated edge, a
    pointer out of range, ids that repeat."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    k, n = F.col("doc_id") % 5, F.size(T.words(F.col("text")))
    ex = B.chain_examples(docs, T.words(F.col("text")), F.array(T.pointer(F.when(k == 2, n + 9).otherwise(0))))
    ex = ex.withColumn("edges", F.when(k == 0, F.concat("edges", F.array(B.edge(F.lit(0), F.col("n_nodes") + 9, F.lit("X"))))).when(k == 1, F.concat("edges", F.slice("edges", 1, 1))).otherwise(F.col("edges")))
    ex = ex.withColumn("nodes", F.when(k == 3, F.transform("nodes", lambda x: T.node(F.least(x["id"], F.lit(1)), x["type"], x["label"]))).otherwise(F.col("nodes")))
    rule = F.explode(F.when(F.size("violations") == 0, F.array(F.lit("none"))).otherwise(F.col("violations")))
    return R.violations(ex).select(rule.alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_dangling FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def referential_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(o, "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n_dangling"))


@query("SELECT user_id, count(*) AS n_edges, sum(nxt - event_id)::BIGINT AS span FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY user_id")
def session_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("nxt"))
    return e.where("nxt is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("nxt") - F.col("event_id")).cast("bigint").alias("span"))


@query("SELECT lang AS task, count(*) AS n, sum(len(string_split(text, ' ')) + 1)::BIGINT AS n_nodes FROM documents GROUP BY 1")
def multitask_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = B.with_task(document_chains(spark, sf_dir), F.col("lang"))
    return ex.groupBy(F.element_at("nodes", -1)["label"].alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nodes").cast("bigint").alias("n_nodes"))


# ---- metrics

_COUNTS = "len(list_filter(p, lambda x: list_contains(t, x))) AS tp, len(p) AS np, len(list_filter(t, lambda x: NOT list_contains(p, x))) AS fn"


@query(f"WITH {_PT}, c AS (SELECT {_COUNTS} FROM pt), s AS (SELECT sum(tp) AS tp, sum(np) AS np, sum(fn) AS fn FROM c) SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM (SELECT {_RATIO.format('tp', 'np')} AS p, {_RATIO.format('tp', 'tp + fn')} AS r FROM s)")
def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp, fp, fn = M.overlap(F.col("p"), F.col("t"))
    s = _pred(spark, sf_dir).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    p, r, f = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select(F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f, 9).alias("f1"))


@query(f"""WITH {_PT}, low AS (SELECT conv_id, turn, list_transform(p, lambda x: lower(x)) AS p, list_transform(p[2:], lambda x: lower(x)) AS q, list_transform(t, lambda x: lower(x)) AS t FROM pt),
    b AS (SELECT conv_id, turn, 0 AS beam, list_distinct(p) AS p, t FROM low UNION ALL SELECT conv_id, turn, 1, list_distinct(q), t FROM low),
    c AS (SELECT conv_id, turn, beam, {_COUNTS} FROM b), m AS (SELECT conv_id, turn, beam, {_RATIO.format('tp', 'np')} AS pr, {_RATIO.format('tp', 'tp + fn')} AS rc FROM c),
    f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM m)
    SELECT conv_id, turn, beam, round(pr, 9) AS precision, round(rc, 9) AS recall, round(f1, 9) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY f1 DESC, beam) = 1""")
def macro_prf_best_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prediction has two beams, the second without its first token; the best F1 counts, the first of equals."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    rows = _pred(spark, sf_dir).withColumns({"t": low("t"), "beams": F.array(low("p"), low(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))))})
    rows = rows.select("conv_id", "turn", "t", F.posexplode("beams").alias("beam", "b")).withColumn("b", F.array_distinct("b"))
    tp, fp, fn = M.overlap(F.col("b"), F.col("t"))
    p, r, f = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    rows = rows.withColumns({"tp": tp, "fp": fp, "fn": fn}).withColumns({"p": p, "r": r, "f": f})
    best = rows.groupBy("conv_id", "turn").agg(F.max(F.struct("f", -F.col("beam"), "beam", "p", "r")).alias("x"))
    return best.select("conv_id", "turn", "x.beam", F.round("x.p", 9).alias("precision"), F.round("x.r", 9).alias("recall"), F.round("x.f", 9).alias("f1"))


@query(f"WITH {_PT} SELECT count(*) AS total, count(*) FILTER (WHERE ptext = ttext) AS exact FROM pt")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pred(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.array_contains(F.array("ptext"), F.col("ttext"))).alias("exact"))


@query("WITH c AS (SELECT toxic AS cls, avg(CASE WHEN toxic = 1 - quality THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n, sum(CASE WHEN toxic = 1 - quality THEN 1 ELSE 0 END) AS hits FROM labels GROUP BY 1) SELECT round(sum(hits) / sum(n)::DOUBLE, 9) AS accuracy, round(avg(acc), 9) AS mean_class_accuracy FROM c")
def class_accuracy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over all, and the mean over the classes that occur; poor quality serves as the prediction of toxic."""
    hit = (F.col("toxic") == 1 - F.col("quality")).cast("int")
    c = table(spark, sf_dir, "labels").groupBy("toxic").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return c.agg(F.round(F.sum("hits") / F.sum("n"), 9).alias("accuracy"), F.round(F.avg(T.safe_ratio(F.col("hits"), F.col("n"))), 9).alias("mean_class_accuracy"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE t % 7 = 1 AND p % 5 = 1) AS bug_free_right, count(*) FILTER (WHERE t % 7 <> 1 AND t % 7 = p % 5) AS loc_right, count(*) FILTER (WHERE t % 7 <> 1 AND t % 7 = p % 5 AND x % 2 = 0) AS loc_repair_right, count(*) FILTER (WHERE p % 11 = 0) AS syntax_errors
    FROM (SELECT event_id AS t, user_id AS p, event_id + user_id AS x FROM events) """)
def loc_repair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localisation and repair from pointer texts; location 1 stands for no bug. Unparsable predictions are counted apart."""
    t, p = F.col("event_id"), F.col("user_id")
    say = lambda at: F.concat(F.lit("POINTER("), at.cast("string"), F.lit(",x)"))
    rows = table(spark, sf_dir, "events").select(say(t % 7).alias("target"), say(p % 5).alias("guess"), ((t + p) % 2 == 0).alias("same"), F.when(p % 11 == 0, "noise").otherwise(say(p % 5)).alias("noisy"))
    a, b = T.parse_pointer(F.col("target")), T.parse_pointer(F.col("guess"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if((a == 1) & (b == 1)).alias("bug_free_right"), F.count_if((a != 1) & (a == b)).alias("loc_right"), F.count_if((a != 1) & (a == b) & F.col("same")).alias("loc_repair_right"), F.count_if(T.parse_pointer(F.col("noisy")).isNull()).alias("syntax_errors"))


@query(f"SELECT op, count(*) AS n, count(*) FILTER (WHERE op <> 'NoOp' AND event_id % 2 = 0) AS hits FROM (SELECT *, {_OPS} AS op FROM events) GROUP BY op")
def edit_op_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right where any beam equals the target; NoOp targets are in the total but never right."""
    rows = _edits(spark, sf_dir).withColumn("beam", F.array(F.lit("x"), F.when(F.col("event_id") % 2 == 0, F.col("script")).otherwise(F.lit("y"))))
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("op") != "NoOp") & F.array_contains("beam", F.col("script"))).alias("hits"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(range(greatest(len(p), len(t)))) AS i, p, t FROM (SELECT c.conv_id, c.turn, string_split(c.text, ' ') AS p, string_split(n.text, ' ') AS t FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn = c.turn + 1)),
    m AS (SELECT conv_id, turn, i, CASE WHEN i < len(p) AND i < len(t) AND p[i + 1] = t[i + 1] THEN 1 ELSE 0 END AS ok FROM w), g AS (SELECT *, sum(1 - ok) OVER (PARTITION BY conv_id, turn ORDER BY i) AS grp FROM m),
    r AS (SELECT conv_id, turn, grp, sum(ok) AS n FROM g GROUP BY 1, 2, 3), s AS (SELECT conv_id, turn, count(*) AS total FROM m GROUP BY 1, 2)
    SELECT r.conv_id, r.turn, CAST(max(n) AS INTEGER) AS longest, round(sum(n * (n + 1)) / (2.0 * max(total)), 9) AS expected FROM r JOIN s ON r.conv_id = s.conv_id AND r.turn = s.turn GROUP BY 1, 2""")
def run_length_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pred(spark, sf_dir).select("conv_id", "turn", M.matches(F.col("p"), F.col("t")).alias("m"))
    longest, expected = M.runs(F.col("m"))
    return rows.select("conv_id", "turn", longest.alias("longest"), F.round(expected, 9).alias("expected"))


@query(f"""WITH {_PT}, n AS (SELECT unnest([1, 2, 3, 4]) AS n), g AS (SELECT conv_id, turn, n, unnest(list_transform(range(1, CAST(len(p) - n + 2 AS BIGINT)), lambda i: array_to_string(p[i:i + n - 1], ' '))) AS gram, 'p' AS side FROM pt, n UNION ALL
    SELECT conv_id, turn, n, unnest(list_transform(range(1, CAST(len(t) - n + 2 AS BIGINT)), lambda i: array_to_string(t[i:i + n - 1], ' '))), 't' FROM pt, n),
    c AS (SELECT conv_id, turn, n, gram, count(*) FILTER (WHERE side = 'p') AS a, count(*) FILTER (WHERE side = 't') AS b FROM g GROUP BY 1, 2, 3, 4)
    SELECT n, sum(least(a, b))::BIGINT AS hits, sum(a)::BIGINT AS total FROM c GROUP BY n""")
def bleu_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped n-gram hits of the whole set for n = 1 to 4, from which corpus BLEU follows."""
    return M.clipped_counts(_pred(spark, sf_dir), ["conv_id", "turn"], "p", "t")


@query("""WITH n AS (SELECT count(*) AS n FROM labels), r AS (SELECT toxic, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM labels), d AS (SELECT b, (('0x'||substr(md5(b || ':' || i), 1, 8))::BIGINT % n) AS idx FROM n, range(100) AS x(b), range(n) AS y(i)),
    s AS (SELECT b, avg(toxic) AS v FROM d JOIN r ON d.idx = r.idx GROUP BY b), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM s) SELECT round(max(v) FILTER (WHERE k = 10), 9) AS lower, round(max(v) FILTER (WHERE k = 89), 9) AS upper FROM o""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 % bounds of the toxic share from 100 samples drawn by hash with replacement."""
    from graphprep.operators.evaluate import draws

    ids = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(1).alias("one"))
    rows = B.running_starts(ids, "doc_id", "one", "idx").select("idx", "toxic")
    draw = lambda b, i, n: F.conv(F.substring(F.md5(F.concat(b.cast("string"), F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("bigint") % n
    means = draws(spark, ids.count(), 100, draw).join(rows.hint("shuffle_hash"), "idx").groupBy("sample").agg(F.avg("toxic").alias("v"))
    lo, hi = M.bootstrap_bounds(100, 90)
    got = means.agg(F.array_sort(F.collect_list("v")).alias("v"))  # 100 values
    return got.select(F.round(F.col("v")[lo], 9).alias("lower"), F.round(F.col("v")[hi], 9).alias("upper"))


# ---- numeric kernels


def _digested(rows: DataFrame, vector: str) -> DataFrame:
    """Add total and weighted: sums over all components of a vector, plain and times their place from 1."""
    added = lambda f: F.round(F.aggregate(F.transform(vector, f), F.lit(0.0), lambda a, v: a + v), 6)
    return rows.withColumns({"total": added(lambda v: v), "weighted": added(lambda v, i: v * (i + 1))})


@query("SELECT p AS pos, d AS dim, round(CASE WHEN d % 2 = 0 THEN sin(p / pow(10000, d / 16.0)) ELSE cos(p / pow(10000, (d - 1) / 16.0)) END, 9) AS value FROM (SELECT vec_id AS p FROM embeddings) a, range(16) b(d)")
def positional_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("dim")
    angle = F.col("pos") / F.pow(F.lit(10000.0), (d - d % 2) / 16.0)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("dim"))
    return rows.select("pos", "dim", F.round(F.when(d % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 9).alias("value"))


@query("""WITH e AS (SELECT vec_id AS src, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS dst FROM embeddings), b AS (SELECT src, dst FROM e WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM e WHERE dst IS NOT NULL)
    SELECT b.dst AS node, count(DISTINCT b.src) AS degree, round(sum(v.embedding[i + 1]::DOUBLE), 6) AS total, round(sum(v.embedding[i + 1]::DOUBLE * (i + 1)), 6) AS weighted FROM b JOIN embeddings v ON v.vec_id = b.src, range(64) r(i) GROUP BY 1""")
def message_pass_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the neighbours' whole states over edges between successive vectors of a label, both ways."""
    v = table(spark, sf_dir, "embeddings")
    e = v.select(F.col("vec_id").alias("src"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("dst")).where("dst is not null")
    e = e.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")
    m = e.join(v.select(F.col("vec_id").alias("src"), F.transform("embedding", lambda x: x.cast("double")).alias("h")), "src")
    return _digested(sum_vectors(m, ["dst"], "h", "h"), "h").select(F.col("dst").alias("node"), F.col("n").alias("degree"), "total", "weighted")


_PAIRS = "q AS (SELECT vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b, lag(embedding, 2) OVER (PARTITION BY label ORDER BY vec_id) AS c FROM embeddings)"


@query(f"WITH {_PAIRS}, s AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: a[i]::DOUBLE * b[i]::DOUBLE)) / 8 AS x, list_sum(list_transform(range(1, 65), lambda i: a[i]::DOUBLE * c[i]::DOUBLE)) / 8 AS y FROM q WHERE c IS NOT NULL) SELECT vec_id, round(x, 6) AS score, round(exp(x - greatest(x, y)) / (exp(x - greatest(x, y)) + exp(y - greatest(x, y))), 6) AS weight FROM s")
def attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled dot products with the two vectors before in the same label, and the softmax weight of the nearer one."""
    w = Window.partitionBy("label").orderBy("vec_id")
    q = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.lag("embedding").over(w).alias("b"), F.lag("embedding", 2).over(w).alias("c")).where("c is not null")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, v: s + v) / 8
    q = q.select("vec_id", dot("a", "b").alias("x"), dot("a", "c").alias("y")).withColumn("m", F.greatest("x", "y"))
    return q.select("vec_id", F.round("x", 6).alias("score"), F.round(F.exp(F.col("x") - F.col("m")) / (F.exp(F.col("x") - F.col("m")) + F.exp(F.col("y") - F.col("m"))), 6).alias("weight"))


@query("WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(ln(list_sum(list_transform(e, lambda v: exp(v - list_max(e))))) + list_max(e) - e[label + 1], 6) AS loss FROM x")
def logsumexp_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of the label under the vector as logits."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e")).withColumn("m", F.array_max("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("m")))
    return x.select("vec_id", F.round(F.log(total) + F.col("m") - F.element_at("e", F.col("label") + 1), 6).alias("loss"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings")
def greedy_decode_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the largest logit, the first of equals."""
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("best"))


@query("SELECT user_id, max(value) AS best, min(event_id) FILTER (WHERE value = m) AS at FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best value of each user and the first event that reached it."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("value", -F.col("event_id"), "event_id")).alias("x"))
    return e.select("user_id", F.col("x.value").alias("best"), F.col("x.event_id").alias("at"))


@query("SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '<start>') AS shifted, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events")
def shift_and_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_type", 1, "<start>").over(w).alias("shifted"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))


# ---- more of the inventory



@query("SELECT task, count(*) AS n FROM (SELECT 'ask' AS task FROM conversations WHERE role = 'user' UNION ALL SELECT 'page' FROM pages UNION ALL SELECT 'item' FROM benchmark) GROUP BY task")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources tagged with their task in one stream of rows."""
    parts = [table(spark, sf_dir, t).where(w).select(F.lit(n).alias("task")) for n, t, w in (("ask", "conversations", "role = 'user'"), ("page", "pages", "true"), ("item", "benchmark", "true"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN url LIKE '%1%' THEN 'train' WHEN url LIKE '%2%' THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM pages GROUP BY 1")
def path_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").groupBy(F.when(url.contains("1"), "train").when(url.contains("2"), "valid").otherwise("test").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, md5(trim(html, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))) AS stripped FROM pages")
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip(F.col("html"))).alias("stripped"))


@query("SELECT item_id, array_to_string(list_filter(string_split(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '([^A-Za-z0-9_])', ' \\1 ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'), '\"', '`'), '''', '`'), ' '), lambda x: x <> ''), ' ') AS toks FROM benchmark")
def bleu_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.bleu_tokens(F.col("text")), " ").alias("toks"))


@query(f"""WITH {_PT}, m AS (SELECT conv_id, turn, unnest(range(len(t))) AS i, p, t FROM pt), e AS (SELECT conv_id, turn, CASE WHEN i < len(p) AND p[i + 1] = t[i + 1] THEN 1 ELSE 0 END AS ok FROM m), s AS (SELECT conv_id, turn, sum(ok) AS ok, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT sum(ok)::BIGINT AS elements_right, sum(n)::BIGINT AS elements, count(*) FILTER (WHERE ok = n) AS sequences_right, count(*) AS sequences FROM s""")
def element_sequence_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive counters of right elements and wholly right sequences, padding left out."""
    hits = F.size(F.filter(F.transform("t", lambda x, i: F.coalesce(F.get("p", i) == x, F.lit(False))), lambda ok: ok))
    rows = _pred(spark, sf_dir).select(hits.alias("ok"), F.size("t").alias("n"))
    return rows.agg(F.sum("ok").cast("bigint").alias("elements_right"), F.sum("n").cast("bigint").alias("elements"), F.count_if(F.col("ok") == F.col("n")).alias("sequences_right"), F.count(F.lit(1)).alias("sequences"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE a = 1) AS bug_free, round(count(*) FILTER (WHERE a <> 1 AND b IS NOT NULL AND b <> 1) / count(*) FILTER (WHERE a <> 1)::DOUBLE, 9) AS true_positive, round(count(*) FILTER (WHERE coalesce((a = 1) = (b = 1), false)) / count(*)::DOUBLE, 9) AS accuracy, round(count(*) FILTER (WHERE a <> 1 AND b = a) / count(*) FILTER (WHERE a <> 1)::DOUBLE, 9) AS localisation
    FROM (SELECT event_id % 4 AS a, CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id % 3 END AS b FROM events)""")
def misuse_repair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification and localisation of variable misuse from pointers; 1 means free of bugs, unparsable is wrong."""
    say = lambda x: F.concat(F.lit("POINTER("), x.cast("string"), F.lit(",v)"))
    rows = table(spark, sf_dir, "events").select(say(F.col("event_id") % 4).alias("t"), F.when(F.col("user_id") % 9 == 0, "?").otherwise(say(F.col("user_id") % 3)).alias("p"))
    rows = rows.select(T.parse_pointer(F.col("t")).alias("a"), T.parse_pointer(F.col("p")).alias("b"))
    a, b = F.col("a"), F.col("b")
    buggy = F.count_if(a != 1)
    right = F.coalesce((a == 1) == (b == 1), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(a == 1).alias("bug_free"), F.round(T.safe_ratio(F.count_if((a != 1) & (b != 1)), buggy), 9).alias("true_positive"), F.round(T.safe_ratio(F.count_if(right), F.count(F.lit(1))), 9).alias("accuracy"), F.round(T.safe_ratio(F.count_if((a != 1) & (a == b)), buggy), 9).alias("localisation"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:label + 1], lambda v: v::DOUBLE)), 6) AS score FROM embeddings")
def sequence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the log probabilities of a sequence up to and with its end, whose place is the label."""
    e = F.slice(F.transform("embedding", lambda v: v.cast("double")), F.lit(1), F.col("label") + 1)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), 6).alias("score"))


@query("SELECT item_id, 'POINTER(' || k || ',' || w[k + 1] || ')' AS said FROM (SELECT item_id, w, CAST(floor(len(w) / 2) AS INTEGER) AS k FROM (SELECT item_id, list_transform(string_split(text, ' '), lambda x: replace(replace(replace(replace(x, chr(92), chr(92)||chr(92)), chr(10), chr(92)||'n'), chr(9), chr(92)||'t'), chr(13), chr(92)||'r')) AS w FROM benchmark))")
def prediction_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointer with the label of the node it points to."""
    ex = pointed_chains(spark, sf_dir)
    at = F.element_at("output", 1)["pointer"]
    return ex.select("item_id", F.concat(F.lit("POINTER("), at.cast("string"), F.lit(","), F.element_at("nodes", at + 1)["label"], F.lit(")")).alias("said"))


@query("SELECT label, max(n) AS n, round(sum(m), 6) AS total, round(sum(m * (i + 1)), 6) AS weighted FROM (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS m, count(*) AS n FROM embeddings, range(64) r(i) GROUP BY 1, 2) GROUP BY label")
def node_embedding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, over all components."""
    v = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    return _digested(sum_vectors(v, ["label"], "h", "h").withColumn("h", F.transform("h", lambda x: x / F.col("n"))), "h").select("label", "n", "total", "weighted")


@query(f"WITH {_PT} SELECT count(*) AS total, count(*) FILTER (WHERE list_contains([ptext, ttext || '?'][1:1], ttext)) AS top1, count(*) FILTER (WHERE list_contains([ptext, ttext][1:2], ttext)) AS top2 FROM pt")
def beam_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches among the first beam and among the first two."""
    rows = _pred(spark, sf_dir).withColumn("beam", F.array("ptext", "ttext"))
    hit = lambda n: F.count_if(F.array_contains(F.slice("beam", 1, n), F.col("ttext")))
    return rows.agg(F.count(F.lit(1)).alias("total"), hit(1).alias("top1"), hit(2).alias("top2"))


@query(f"WITH {_PT} SELECT conv_id, turn, CAST(len(list_distinct(list_intersect(p, t))) AS INTEGER) AS shared, CAST(len(list_filter(list_distinct(p), lambda x: NOT list_contains(t, x))) AS INTEGER) AS extra FROM pt")
def token_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pred(spark, sf_dir).select("conv_id", "turn", F.size(F.array_intersect("p", "t")).alias("shared"), F.size(F.array_except("p", "t")).alias("extra"))


@query("SELECT CASE WHEN toxic = 1 THEN 'CLASS_toxic' ELSE 'CLASS_clean' END AS target, count(*) AS n, sum(len(string_split(text, ' ')))::BIGINT AS n_nodes FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def class_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token chains whose output is a class."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    ex = B.chain_examples(rows, T.words(F.col("text")), F.array(T.label_class(F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))))
    return ex.groupBy(F.element_at(T.linearise(F.col("output"), done=False), 1).alias("target")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nodes").cast("bigint").alias("n_nodes"))


@query("SELECT i AS graph, CAST(10 + i % 91 AS INTEGER) AS n_nodes, CAST(2 * (9 + i % 91) AS INTEGER) AS n_edges, CAST((10 + i % 91 + 1) // 2 AS INTEGER) AS n_candidates FROM (SELECT o_orderkey AS i FROM orders) x")
def synthetic_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of letters for each order; nodes with even ids are candidates."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).select(F.col("id").alias("graph"), F.transform(F.sequence(F.lit(0).cast("long"), 9 + F.col("id") % 91), lambda i: F.char(97 + (i * 7 + F.col("id")) % 26)).alias("w"))
    ex = B.repair_examples(rows, F.col("w"), lambda ws, t, i: i % 2 == 0, F.array(T.pointer(F.lit(0))))
    return ex.select("graph", "n_nodes", "n_edges", F.size(F.filter("nodes", lambda n: n["is_repair_candidate"])).alias("n_candidates"))


@query(f"""WITH {_TOK}, {_VOCAB} SELECT lab.doc_id, count(*) AS n, sum(coalesce(v.id, 0))::BIGINT AS sum_ids, sum(coalesce(v.id, 0) * (lab.pos % 97))::BIGINT AS weighted FROM lab LEFT JOIN voc v ON lab.label = v.label GROUP BY 1""")
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer-encoded node labels of each example, as digests of the id lists."""
    found = E.lookup(_labels(spark, sf_dir), _vocab(spark, sf_dir), "node_label")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").cast("bigint").alias("sum_ids"), F.sum(F.col("id") * (F.col("pos") % 97)).cast("bigint").alias("weighted"))


@query("SELECT lang, split, count(*) AS n FROM (SELECT lang, " + _SPLIT + " AS split FROM documents) WHERE split <> 'train' OR lang = 'en' GROUP BY 1, 2")
def multitask_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows of one task, validation and test rows of all."""
    rows = table(spark, sf_dir, "documents").select("lang", R.split_of(F.col("doc_id")).alias("split"))
    return rows.where((F.col("split") != "train") | (F.col("lang") == "en")).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PT}, n AS (SELECT unnest([1, 2, 3, 4]) AS n), g AS (SELECT conv_id, turn, n, unnest(list_transform(range(1, CAST(len(p) - n + 2 AS BIGINT)), lambda i: array_to_string(p[i:i + n - 1], ' '))) AS gram, 'p' AS side FROM pt, n UNION ALL
    SELECT conv_id, turn, n, unnest(list_transform(range(1, CAST(len(t) - n + 2 AS BIGINT)), lambda i: array_to_string(t[i:i + n - 1], ' '))), 't' FROM pt, n),
    c AS (SELECT conv_id, turn, n, gram, count(*) FILTER (WHERE side = 'p') AS a, count(*) FILTER (WHERE side = 't') AS b FROM g GROUP BY 1, 2, 3, 4),
    s AS (SELECT n, sum(least(a, b)) AS hits, sum(a) AS total FROM c GROUP BY n), l AS (SELECT sum(len(p)) AS lp, sum(len(t)) AS lt FROM pt)
    SELECT round(100 * CASE WHEN min(hits) = 0 THEN 0 ELSE exp(avg(ln(hits / total::DOUBLE))) END * max(CASE WHEN lp >= lt THEN 1 ELSE exp(1 - lt / lp::DOUBLE) END), 6) AS bleu FROM s, l""")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU-4 of all predictions: geometric mean of the clipped precisions (0 if one is 0) and the brevity penalty, times 100."""
    pairs = _pred(spark, sf_dir)
    counts = M.clipped_counts(pairs, ["conv_id", "turn"], "p", "t")
    sizes = pairs.agg(F.sum(F.size("p")).alias("lp"), F.sum(F.size("t")).alias("lt"))
    mean = counts.agg(F.min("hits").alias("least"), F.avg(F.when(F.col("hits") > 0, F.log(F.col("hits") / F.col("total")))).alias("mean"))
    short = F.when(F.col("lp") >= F.col("lt"), 1.0).otherwise(F.exp(1 - F.col("lt") / F.col("lp")))
    return mean.crossJoin(F.broadcast(sizes)).select(F.round(100 * F.when(F.col("least") == 0, 0.0).otherwise(F.exp("mean")) * short, 6).alias("bleu"))  # one row each


@query("SELECT doc_id, CAST(least(len(string_split(text, ' ')), 254) + 2 AS INTEGER) AS n_nodes, 0 AS n_edges FROM documents")
def flat_class_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtokens between delimiters, cut to 256, with a class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return B.flat_examples(docs, T.words(F.col("text")), 256, F.array(T.label_class(F.col("lang")))).select("doc_id", "n_nodes", "n_edges")


@query(f"WITH {_PT}, x AS (SELECT conv_id, turn, len(p) AS a, len(t) AS b FROM pt) SELECT conv_id, turn, CAST(least(a + b, 61) + 3 AS INTEGER) AS n_nodes, CAST(CASE WHEN a + b > 61 THEN least(a, greatest(61 - b, 31)) ELSE a END + 2 AS INTEGER) AS n_first FROM x")
def two_sequence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = B.two_sequence_examples(_pred(spark, sf_dir), F.col("p"), F.col("t"), 64, F.array(T.label_class(F.lit("Correct"))))
    return ex.select("conv_id", "turn", "n_nodes", F.size(F.filter("nodes", lambda n: n["type"] == "DOCSTRING")).alias("n_first"))


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), k AS (SELECT item_id, w, item_id % 40 AS k FROM w WHERE item_id % 40 < least(len(w), 30))
    SELECT item_id, CAST(least(len(w), 30) + 2 AS INTEGER) AS n_nodes, CAST(k + 1 AS INTEGER) AS at, CASE WHEN k = 0 THEN NULL ELSE replace(w[2], chr(10), chr(92)||'n') END AS fix, CAST(len(list_filter(range(least(len(w), 30)), lambda i: i % 3 = 1)) AS INTEGER) AS n_candidates FROM k""")
def masked_repair_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair examples from masks, cut to 32 tokens: the error stands at item_id % 40, the right token at 1, 4, 7, ..."""
    rows = table(spark, sf_dir, "benchmark").withColumn("w", T.words(F.col("text"))).withColumn("k", F.col("item_id") % 40)
    third = F.transform("w", lambda t, i: (i % 3 == 1).cast("int"))
    rows = rows.withColumns({"err": F.transform("w", lambda t, i: (i == F.col("k")).cast("int")), "tgt": third, "cand": third})
    ex = B.masked_repair_examples(rows, "w", "err", "tgt", "cand", 32)
    return ex.select("item_id", "n_nodes", F.element_at("output", 1)["pointer"].alias("at"), F.get("output", F.lit(1))["token"].alias("fix"), F.size(F.filter("nodes", lambda n: n["is_repair_candidate"])).alias("n_candidates"))
