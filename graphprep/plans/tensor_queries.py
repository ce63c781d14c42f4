"""Queries of padded tensors, batches and numeric kernels, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphprep.functions import text as T
from graphprep.operators import kernels as K
from graphprep.operators import rules as R
from graphprep.operators import tensors as X
from graphprep.plans import dataset as D
from graphprep.plans.examples import pointed_chains, table
from graphprep.plans.queries import _ESC, _SPLIT, query


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointed_chains(spark, sf_dir).withColumns({"example_id": F.col("item_id").cast("string"), "split": R.split_of(F.col("item_id")), "provenance": F.lit("benchmark")})


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = _items(spark, sf_dir)
    vocab = D.vocabularies(items, 200)
    return D.features(items, vocab, drop_impossible=False), vocab


_W = f"w AS (SELECT item_id, CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'valid' ELSE 'test' END AS split, l, CAST(floor(len(l) / 2) AS INTEGER) AS mid FROM (SELECT item_id, (('0x'||substr(md5('split:'||CAST(item_id AS VARCHAR)),1,8))::BIGINT % 100) AS p, list_transform(string_split(text, ' '), lambda x: {_ESC.format('x')}) AS l FROM benchmark))"
_IDS = """k AS (SELECT word, count(*) AS n FROM (SELECT unnest(l) AS word FROM w WHERE split = 'train') GROUP BY 1), lv AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS id FROM k QUALIFY row_number() OVER (ORDER BY n DESC, word) <= 198),
    ok AS (SELECT word, count(*) AS n FROM (SELECT unnest(['POINTER', l[1], 'DONE']) AS word FROM w WHERE split = 'train') GROUP BY 1), ov AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS id FROM ok QUALIFY row_number() OVER (ORDER BY n DESC, word) <= 198)"""


@query(f"""WITH {_W}, {_IDS}, x AS (SELECT item_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM w), n AS (SELECT x.item_id, sum(coalesce(lv.id, 0) * (pos + 1))::BIGINT AS labels FROM x LEFT JOIN lv ON lv.word = x.word GROUP BY 1),
    y AS (SELECT item_id, unnest(['POINTER', l[1], 'DONE']) AS word, unnest([1, 2, 3]) AS pos FROM w), o AS (SELECT y.item_id, sum(coalesce(ov.id, 0) * pos)::BIGINT AS outputs FROM y LEFT JOIN ov ON ov.word = y.word GROUP BY 1),
    c AS (SELECT item_id, count(*) AS n_copies, sum(pos)::BIGINT AS copies FROM x JOIN (SELECT item_id AS i, l[1] AS first FROM w) f ON f.i = x.item_id AND f.first = x.word GROUP BY 1)
    SELECT CAST(w.item_id AS VARCHAR) AS example_id, n.labels, o.outputs, c.n_copies, c.copies, w.mid AS pointer, CAST(2 * (len(l) - 1) AS BIGINT) AS n_edges FROM w JOIN n ON n.item_id = w.item_id JOIN o ON o.item_id = w.item_id JOIN c ON c.item_id = w.item_id""")
def example_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole feature rows of items, as digests of their lists."""
    rows, _ = _features(spark, sf_dir)
    digest = lambda c: F.aggregate(F.transform(c, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, v: s + v)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: s + v)
    return rows.select("example_id", digest("node_label_ids").alias("labels"), digest("target_token_ids").alias("outputs"), F.size("copy_in").cast("bigint").alias("n_copies"), total("copy_in").alias("copies"), F.element_at("pointer_in", 1).alias("pointer"), F.size("edge_src").cast("bigint").alias("n_edges"))


@query(f"""WITH {_W}, f AS (SELECT item_id, split, l, mid, row_number() OVER (PARTITION BY split ORDER BY item_id) - 1 AS k FROM w),
    s AS (SELECT *, k // 8 AS batch, coalesce(sum(len(l)) OVER (PARTITION BY split, k // 8 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS node, (k % 8) * 3 AS output FROM f),
    x AS (SELECT item_id, sum(range)::BIGINT AS pos, count(*) AS n FROM (SELECT item_id, l, unnest(range(len(l))) AS range FROM f) WHERE l[range + 1] = l[1] GROUP BY 1)
    SELECT split, batch, count(*) AS n_graphs, sum(len(l))::BIGINT AS n_nodes, sum(2 * (len(l) - 1))::BIGINT AS n_edges, sum((len(l) - 1) * (len(l) - 1) + 2 * (len(l) - 1) * node)::BIGINT AS sum_src, sum(x.pos + x.n * node)::BIGINT AS sum_copy_in, sum(x.n * (output + 1))::BIGINT AS sum_copy_out, sum(mid + node)::BIGINT AS sum_pointer_in
    FROM s JOIN x USING (item_id) GROUP BY split, batch""")
def sparse_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight graphs of a split side by side in one: sizes, and sums of what points to nodes and outputs."""
    rows, _ = _features(spark, sf_dir)
    held = X.sparse_batches(rows.withColumn("turn", F.col("example_id").cast("long")), ["split"], "turn", 8, drop_remainder=False)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: s + v)
    last = lambda c: F.element_at(c, -1).cast("bigint")
    return held.select("split", "batch", F.size("example_ids").cast("bigint").alias("n_graphs"), last("node_splits").alias("n_nodes"), last("edge_splits").alias("n_edges"), total("edge_src").alias("sum_src"), total("copy_in").alias("sum_copy_in"), total("copy_out").alias("sum_copy_out"), total("pointer_in").alias("sum_pointer_in"))


@query(f"WITH {_W} SELECT max(len(l)) AS nodes, 3 AS outputs, 4 AS edge_types, 1 AS subtokens FROM w")
def padding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all splits are padded to."""
    rows, vocab = _features(spark, sf_dir)
    s = X.padding_sizes(rows, vocab)
    return spark.createDataFrame([(s.nodes, s.outputs, s.edge_types, s.subtokens)], "nodes long, outputs int, edge_types int, subtokens int")


@query(f"""WITH {_W}, m AS (SELECT max(len(l)) AS n FROM w), x AS (SELECT item_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM w)
    SELECT CAST(w.item_id AS VARCHAR) AS example_id, 3 * n AS cells, (SELECT count(*) FROM x WHERE x.item_id = w.item_id AND x.word = l[1]) AS n_copies, (SELECT sum(n + x.pos)::BIGINT FROM x WHERE x.item_id = w.item_id AND x.word = l[1]) AS copies, CAST(mid AS BIGINT) AS pointers FROM w, m""")
def dense_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy and pointer pairs as 0/1 matrices (output, node): numbers of cells and ones, sums of the places of ones in the flat matrix."""
    rows, vocab = _features(spark, sf_dir)
    s = X.padding_sizes(rows, vocab)
    rows = X.padded(rows, s).select("example_id", F.flatten(X.dense_pairs(F.col("copy_out"), F.col("copy_in"), s.outputs, s.nodes)).alias("c"), F.flatten(X.dense_pairs(F.col("pointer_out"), F.col("pointer_in"), s.outputs, s.nodes)).alias("p"))
    total = lambda c, f: F.aggregate(F.transform(c, f), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return rows.select("example_id", F.size("c").cast("bigint").alias("cells"), total("c", lambda v: v.cast("bigint")).alias("n_copies"), total("c", lambda v, i: v.cast("bigint") * i).alias("copies"), total("p", lambda v, i: v.cast("bigint") * i).alias("pointers"))


@query(f"""WITH {_W}, m AS (SELECT max(len(l)) AS n FROM w), t AS (SELECT type, row_number() OVER (ORDER BY c DESC, type) + 1 AS id FROM (SELECT unnest(['NEXT_TOKEN', 'REVERSED_NEXT_TOKEN']) AS type, sum(len(l) - 1) AS c FROM w GROUP BY 1)),
    e AS (SELECT item_id, n, unnest(range(len(l) - 1)) AS i FROM w, m), d AS (SELECT item_id, n, CASE WHEN type = 'NEXT_TOKEN' THEN i ELSE i + 1 END AS s, CASE WHEN type = 'NEXT_TOKEN' THEN i + 1 ELSE i END AS d, id FROM e, t)
    SELECT CAST(item_id AS VARCHAR) AS example_id, count(*) AS n_ones, sum((id * n + s) * n + d)::BIGINT AS places FROM d GROUP BY 1""")
def dense_edge_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as a 0/1 tensor (type, source, destination): ones and the sum of their places in the flat tensor."""
    rows, vocab = _features(spark, sf_dir)
    s = X.padding_sizes(rows, vocab)
    rows = rows.where(F.size("edge_src") > 0).select("example_id", F.flatten(F.flatten(X.dense_edges(F.col("edge_type_ids"), F.col("edge_src"), F.col("edge_dst"), s.edge_types, s.nodes))).alias("e"))
    total = lambda f: F.aggregate(F.transform("e", f), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return rows.select("example_id", total(lambda v: v.cast("bigint")).alias("n_ones"), total(lambda v, i: v.cast("bigint") * i).alias("places"))


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS l FROM benchmark), x AS (SELECT item_id, i, w.l[i + 1] AS word FROM w, range(40) r(i)), c AS (SELECT item_id, i, k, CASE WHEN k < length(word) THEN unicode(substr(word, k + 1, 1)) ELSE 1 END AS v FROM x, range(8) q(k))
    SELECT item_id, 320::BIGINT AS cells, sum(v * (i * 8 + k + 1))::BIGINT AS digest FROM c GROUP BY 1""")
def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of words as subtokens: a flat array and the words' lengths to 40 x 8, padded and cut."""
    rows = table(spark, sf_dir, "benchmark").withColumn("w", T.words(F.col("text")))
    codes = F.flatten(F.transform("w", lambda t: F.when(t == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(t, "", -1), F.ascii))))
    rows = rows.select("item_id", F.flatten(X.ragged(codes, F.transform("w", F.length), 40, 8)).alias("m"))
    return rows.select("item_id", F.size("m").cast("bigint").alias("cells"), F.aggregate(F.transform("m", lambda v, i: v.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("digest"))


@query(f"""WITH d AS (SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS k FROM (SELECT doc_id, {_SPLIT} AS split FROM documents))
    SELECT split, k // 16 AS batch, CAST(count(*) AS INTEGER) AS size, sum(doc_id * (k % 16 + 1))::BIGINT AS digest FROM d GROUP BY 1, 2""")
def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a split in order, 16 to a row, the rest in a last row."""
    rows = table(spark, sf_dir, "documents").select("doc_id", R.split_of(F.col("doc_id")).alias("split"), F.col("doc_id").alias("id"))
    held = X.batched(rows, ["split"], "doc_id", 16, ["id"], drop_remainder=False)
    return held.select("split", "batch", F.size("id").alias("size"), F.aggregate(F.transform("id", lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("digest"))


@query(f"WITH n AS (SELECT count(*) AS n FROM (SELECT {_SPLIT} AS split FROM documents) WHERE split = 'train') SELECT epoch, n // 32 AS n_batches, (n // 32) * 32 AS n_rows FROM n, range(2) e(epoch)")
def training_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of shuffled train batches without remainders: batches and different rows in each epoch."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), R.split_of(F.col("doc_id")).alias("split"), F.col("doc_id").alias("id"))
    held = X.training_batches(rows, "train", 32, ["id"], seed=3, epochs=2)
    each = held.select(F.col("epoch").cast("bigint").alias("epoch"), "batch", F.explode("id").alias("id"))
    return each.groupBy("epoch").agg(F.countDistinct("batch").alias("n_batches"), F.countDistinct("id").alias("n_rows"))


@query(f"WITH {_W}, {_IDS} SELECT CAST(item_id AS VARCHAR) AS example_id, CASE WHEN l[1] IN (SELECT word FROM ov) THEN 'POINTER ' || l[1] ELSE 'POINTER <OOV>' END || ' DONE' AS said FROM w")
def decoded_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output ids back to words; what the vocabulary did not have is <OOV>."""
    rows, vocab = _features(spark, sf_dir)
    found = X.decode(rows.select("example_id", F.posexplode("target_token_ids").alias("pos", "id")), vocab, "output_token")
    return found.groupBy("example_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("said"))


# ---- numeric kernels: vectors of embeddings as states, successive ones of a label as neighbours

_NEXT = "e AS (SELECT vec_id AS src, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS dst FROM embeddings), b AS (SELECT src, dst, 0 AS type FROM e WHERE dst IS NOT NULL UNION ALL SELECT dst, src, 1 FROM e WHERE dst IS NOT NULL)"
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS h FROM embeddings)"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("h"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive vectors of a label, forward as type 0 and back as type 1."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), F.lead("vec_id").over(w).alias("dst")).where("dst is not null")
    return e.select("src", "dst", F.lit(0).alias("type")).union(e.select("dst", "src", F.lit(1)))


def _kernels(spark: SparkSession, size: int = 64) -> DataFrame:
    """A kernel and a bias for each of two edge types, by a rule that SQL can state."""
    rows = spark.range(2).select(F.col("id").cast("int").alias("type"))
    at = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    w = F.transform(at(size), lambda j: F.transform(at(size), lambda i: ((j * 3 + i * 5 + F.col("type") * 7) % 11 - 5) / 10.0))
    return rows.select("type", w.alias("w"), F.transform(at(size), lambda i: ((i + F.col("type")) % 3) / 10.0).alias("b"))


@query(f"""WITH {_NEXT}, {_V}, s AS (SELECT b.dst AS node, b.type, count(*) AS n, list_transform(range(1, 65), lambda j: 0.0) AS z FROM b GROUP BY 1, 2), x AS (SELECT b.dst AS node, b.type, j, sum(v.h[j + 1]) AS t FROM b JOIN v ON v.vec_id = b.src, range(64) r(j) GROUP BY 1, 2, 3),
    y AS (SELECT node, type, i, sum(t * (((j * 3 + i * 5 + type * 7) % 11 - 5) / 10.0)) AS m FROM x, range(64) q(i) GROUP BY 1, 2, 3), m AS (SELECT y.node, y.i, sum(y.m + s.n * (((y.i + y.type) % 3) / 10.0)) AS m FROM y JOIN s ON s.node = y.node AND s.type = y.type GROUP BY 1, 2)
    SELECT node, round(sum(m), 6) AS total, round(sum(m * (i + 1)), 6) AS weighted FROM m GROUP BY node""")
def message_pass_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of typed edges over whole states: kernels by edge type, biases by the number of edges that come in."""
    m = K.typed_messages(_edges(spark, sf_dir), _states(spark, sf_dir), _kernels(spark))
    total = lambda f: F.round(F.aggregate(F.transform("message", f), F.lit(0.0), lambda a, v: a + v), 6)
    return m.select("node", total(lambda v: v).alias("total"), total(lambda v, i: v * (i + 1)).alias("weighted"))


_PAIR = f"{_V}, r AS (SELECT vec_id, label, h, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM v), p AS (SELECT a.vec_id AS q, b.vec_id AS k, a.h AS hq, b.h AS hk, a.k - b.k AS gap FROM r a JOIN r b ON a.label = b.label AND b.k BETWEEN a.k - 3 AND a.k)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vectors a vector looks at: itself and the three before it in its label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, sf_dir, "embeddings").select("vec_id", *[F.lag("vec_id", g).over(w).alias(f"k{g}") for g in range(4)])
    seen = F.array(*[F.struct(F.lit(g).alias("gap"), F.col(f"k{g}").alias("key")) for g in range(4)])
    return v.select(F.col("vec_id").alias("query"), F.explode(seen).alias("x")).select("query", "x.key", "x.gap").where("key is not null")


def _attention_sql(score: str) -> str:
    return f"""WITH {_PAIR}, s AS (SELECT q, head, k, hk, {score} AS s FROM p, range(4) t(head)), z AS (SELECT *, exp(s - max(s) OVER (PARTITION BY q, head)) AS e FROM s), w AS (SELECT q, head, hk, e / sum(e) OVER (PARTITION BY q, head) AS pr FROM z),
        o AS (SELECT q, head, i, sum(pr * hk[head * 16 + i + 1]) AS x FROM w, range(16) u(i) GROUP BY 1, 2, 3) SELECT q AS query, round(sum(x), 6) AS total, round(sum(x * (head * 16 + i + 1)), 6) AS weighted FROM o GROUP BY q"""


_DOT = "list_sum(list_transform(range(1, 17), lambda i: hq[head * 16 + i] * hk[head * 16 + i])) / 4"


def _attended(found: DataFrame) -> DataFrame:
    total = lambda f: F.round(F.aggregate(F.transform("h", f), F.lit(0.0), lambda a, v: a + v), 6)
    return found.select("query", total(lambda v: v).alias("total"), total(lambda v, i: v * (i + 1)).alias("weighted"))


@query(_attention_sql(_DOT))
def masked_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention in four heads over the vectors that a mask allows."""
    v = _states(spark, sf_dir)
    return _attended(K.attend(_pairs(spark, sf_dir), v, v, v, heads=4))


@query(_attention_sql(_DOT + " + list_sum(list_transform(range(1, 17), lambda i: hk[head * 16 + i])) * (gap / 10.0)"))
def biased_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention whose scores lean by the relation of two vectors, times the sum of the key."""
    v = _states(spark, sf_dir)
    return _attended(K.attend(_pairs(spark, sf_dir).withColumn("bias", F.col("gap") / 10.0), v, v, v, heads=4))


@query(f"""WITH {_V}, t AS (SELECT vec_id, i, CASE WHEN i < 32 THEN sin(2 * pi() * (1 + vec_id % 512) / pow(512, i / 32.0)) ELSE cos(2 * pi() * (1 + vec_id % 512) / pow(512, (i - 32) / 32.0)) END AS e FROM v, range(64) r(i))
    SELECT v.vec_id AS node, round(sum(v.h[t.i + 1] / 1.00001 + e), 6) AS total, round(sum((v.h[t.i + 1] / 1.00001 + e) * (t.i + 1)), 6) AS weighted FROM v JOIN t ON t.vec_id = v.vec_id GROUP BY 1""")
def node_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a node's subtoken vectors (here its own) plus the encoding of its place among 512."""
    v = _states(spark, sf_dir)
    found = v.withColumn("x", K.add(K.mean_of(F.array("h")), K.place_encoding(F.col("node") % 512, 512, 64)))
    total = lambda f: F.round(F.aggregate(F.transform("x", f), F.lit(0.0), lambda a, b: a + b), 6)
    return found.select("node", total(lambda a: a).alias("total"), total(lambda a, i: a * (i + 1)).alias("weighted"))


@query(f"""WITH {_V}, x AS (SELECT vec_id, h[1:32] AS tk, h[33:48] AS cp, h[49:64] AS po, CAST(label AS INTEGER) AS t, vec_id % 4 = 0 AS is_po, vec_id % 16 AS spot FROM v),
    s AS (SELECT vec_id, t, list_max(list_concat(tk, cp, po)) AS m, tk, cp, po, is_po, spot FROM x), y AS (SELECT *, ln(list_sum(list_transform(list_concat(tk, cp, po), lambda v: exp(v - m)))) + m AS z FROM s),
    g AS (SELECT vec_id, z, list_filter([CASE WHEN NOT is_po AND t <> 0 THEN tk[t + 1] END, cp[spot + 1], CASE WHEN is_po THEN po[spot + 1] END], lambda v: v IS NOT NULL) AS c, t FROM y)
    SELECT vec_id, round(CASE WHEN t = 1 THEN 0 ELSE ln(list_sum(list_transform(c, lambda v: exp(v - list_max(c))))) + list_max(c) - z END, 6) AS logprob FROM g""")
def output_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of a wanted output among tokens, copies and pointers: all ways to it count; padding is certain."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("token_id"), F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    at, none = F.array((F.col("vec_id") % 16).cast("int")), F.array().cast("array<int>")
    lp = K.output_logprob(F.slice("h", 1, 32), F.slice("h", 33, 16), F.slice("h", 49, 16), F.col("token_id"), at, F.when(F.col("vec_id") % 4 == 0, at).otherwise(none))
    return v.select("vec_id", F.round(lp, 6).alias("logprob"))


@query(f"""WITH {_V}, x AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i <= 48 OR i % 2 = 1 THEN h[i] ELSE -1000000000.0 END) AS l FROM v), y AS (SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS k FROM x)
    SELECT vec_id, CASE WHEN k < 32 THEN 'token' WHEN k < 48 THEN 'copy' ELSE 'pointer' END AS head, CASE WHEN k < 32 THEN k WHEN k < 48 THEN k - 32 ELSE k - 48 END AS choice FROM y""")
def greedy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest of all tokens, copies and pointers; pointers only to candidates, the even places here."""
    v = _states(spark, sf_dir)
    candidates = F.array(*[F.lit(i) for i in range(0, 16, 2)])
    best = K.choose(F.slice("h", 1, 32), F.slice("h", 33, 16), K.only(F.slice("h", 49, 16), candidates))
    return v.select(F.col("node").alias("vec_id"), best["head"].alias("head"), best["choice"].alias("choice"))


@query(f"""WITH {_V}, s AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS step, h[1] AS lp, vec_id % 7 = 0 AS done FROM v), c AS (SELECT *, coalesce(sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT CAST(label AS BIGINT) AS seq, round(sum(lp), 6) AS score, count(*) AS n_steps FROM c WHERE before = 0 GROUP BY label""")
def decoded_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the log probabilities of a sequence's choices up to and with the first that ends it."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("seq"), F.col("vec_id").alias("step"), F.col("embedding")[0].cast("double").alias("logprob"), (F.col("vec_id") % 7 == 0).alias("done"))
    return K.sequence_scores(v).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_V}, n AS (SELECT max(vec_id) + 1 AS n FROM v), w AS (SELECT label AS seq, min(vec_id) AS place, 0 AS step, false AS done FROM v GROUP BY label UNION ALL
    SELECT seq, (place * 7 + list_position(h, list_max(h))) % n, step + 1, (place * 7 + list_position(h, list_max(h))) % n % 5 = 0 FROM w JOIN v ON v.vec_id = w.place, n WHERE NOT done AND step < 8)
    SELECT CAST(seq AS BIGINT) AS seq, CAST(step AS INTEGER) AS step, place, done FROM w""")
def decode_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state that moves on by its likeliest choice until an end or eight steps: the loop of decoding, all sequences at once."""
    v = _states(spark, sf_dir)
    n = v.agg(F.max("node") + 1).first()[0]
    start = v.groupBy(F.col("label").cast("bigint").alias("seq")).agg(F.min("node").alias("at")).withColumns({"step": F.lit(0), "done": F.lit(False)})

    def advance(states: DataFrame) -> DataFrame:
        best = F.array_position("h", F.array_max("h"))
        there = states.join(v.select(F.col("node").alias("at"), "h"), "at")
        return there.select("seq", ((F.col("at") * 7 + best) % n).alias("at"), (F.col("step") + 1).alias("step")).withColumn("done", F.col("at") % 5 == 0).select("seq", "at", "step", "done")

    return K.decode_loop(start, advance, most=8).withColumnRenamed("at", "place")


@query(f"""WITH RECURSIVE {_W}, t AS (SELECT item_id, 0 AS step, 0 AS place, CAST([] AS BIGINT[]) AS copies, '' AS word, l FROM w UNION ALL
    SELECT item_id, step + 1, q, list_filter(range(len(l)), lambda i: l[i + 1] = l[q + 1]), l[q + 1], l FROM (SELECT *, (coalesce(copies[-1], 0) * 3 + step + 1) % len(l) AS q FROM t) WHERE step < 4)
    SELECT CAST(item_id AS VARCHAR) AS example_id, string_agg(word, ' ' ORDER BY step) AS said, sum(len(copies))::BIGINT AS n_copies, sum(coalesce(list_sum(copies), 0))::BIGINT AS places FROM t WHERE step > 0 GROUP BY item_id""")
def decoded_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words of each item, each chosen from the last of the nodes that could have been copied for the one before."""
    from graphprep.operators import decoding

    items = _items(spark, sf_dir)
    rows, vocab = items.select("example_id", F.col("nodes.label").alias("node_texts")), D.vocabularies(items, 200)

    def choose(states: DataFrame) -> DataFrame:
        sized = states.join(rows.select("example_id", F.size("node_texts").alias("n")), "example_id")
        last = F.coalesce(F.try_element_at("copies", F.lit(-1)), F.lit(0))
        return sized.select("example_id", F.lit("copy").alias("head"), ((last * 3 + F.col("step") + 1) % F.col("n")).alias("choice"))

    states = decoding.decode(rows, vocab, choose, 4).where("step > 0")
    total = F.aggregate("copies", F.lit(0).cast("bigint"), lambda s, v: s + v)
    sums = states.groupBy("example_id").agg(F.sum(F.size("copies")).cast("bigint").alias("n_copies"), F.sum(total).cast("bigint").alias("places"))
    return decoding.outputs(states).join(sums, "example_id")
