"""Queries of the metric sets on predictions made from the supplied tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprep.functions import text as T
from graphprep.operators import evaluate as V
from graphprep.operators.metrics import bootstrap_bounds
from graphprep.plans.examples import table
from graphprep.plans.queries import _PT, _RATIO, _pred, counted, query


def _values(cells: dict[str, str], source: str) -> str:
    """SQL for rows (metric, value), values to nine places."""
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, round(CAST({e} AS DOUBLE), 9) AS value FROM {source}" for n, e in cells.items())


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.round("value", 9))


def _turns(spark: SparkSession, sf_dir: str, idx: Column | None = None) -> DataFrame:
    """Turns as predictions of the next ones, numbered: beams are the turn and the next one without its first word."""
    rest = F.array_join(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), " ")
    return _pred(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn") if idx is None else idx).alias("idx"), F.array(F.col("ptext"), rest).alias("beam"), F.col("ttext").alias("target"))


_BEAMS = "bm AS (SELECT conv_id, turn, 0 AS rank, p AS w, t, ptext AS bt, ttext FROM pt UNION ALL SELECT conv_id, turn, 1, CASE WHEN len(t) > 1 THEN t[2:] ELSE [''] END, t, CASE WHEN len(t) > 1 THEN array_to_string(t[2:], ' ') ELSE '' END, ttext FROM pt)"
_SUMS = "sum(tp) AS tp, sum(np) AS np, sum(fn) AS fn"
_F1 = "CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END"


@query(f"""WITH {_PT}, f AS (SELECT list_filter(list_append(p, '<OOV>'), lambda x: x NOT IN ('<OOV>', '<pad>')) AS p, t FROM pt), c AS (SELECT len(list_filter(p, lambda x: list_contains(t, x))) AS tp, len(p) AS np, len(list_filter(t, lambda x: NOT list_contains(p, x))) AS fn FROM f),
    s AS (SELECT {_SUMS} FROM c), m AS (SELECT {_RATIO.format('tp', 'np')} AS p, {_RATIO.format('tp', 'tp + fn')} AS r FROM s) {_values({'precision': 'p', 'recall': 'r', 'f1_score': _F1}, 'm')}""")
def eval_token_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions end in an <OOV> that does not count."""
    rows = _turns(spark, sf_dir).withColumn("beam", F.array(F.concat(F.element_at("beam", 1), F.lit(" <OOV>"))))
    return _rounded(V.evaluate(rows, "code2seq_dataset"))


@query(f"""WITH {_PT}, {_BEAMS}, low AS (SELECT conv_id, turn, rank, list_distinct(list_transform(w, lambda x: lower(x))) AS p, list_transform(t, lambda x: lower(x)) AS t, bt = ttext AS same FROM bm),
    c AS (SELECT *, len(list_filter(p, lambda x: list_contains(t, x))) AS tp, len(p) AS np, len(list_filter(t, lambda x: NOT list_contains(p, x))) AS fn FROM low), m AS (SELECT conv_id, turn, rank, same, {_RATIO.format('tp', 'np')} AS p, {_RATIO.format('tp', 'tp + fn')} AS r FROM c),
    f AS (SELECT *, {_F1} AS f1 FROM m), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY f1 DESC, rank) = 1) {_values({'precision': 'avg(p)', 'recall': 'avg(r)', 'f1_score': 'avg(f1)', 'exact_match_percentage': 'avg(CASE WHEN same THEN 1.0 ELSE 0.0 END)'}, 'b')}""")
def eval_name_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.evaluate(_turns(spark, sf_dir), "convattn_dataset"))


_LOGS = " + ".join("ln(greatest(h{0}, 2.2250738585072014e-308) / greatest(t{0}, 1))".format(n) for n in range(1, 5))
_BLEU = {f"bleu_{n}": f"CASE WHEN h1 = 0 THEN 0 ELSE 100 * bp * exp(({' + '.join(f'ln(greatest(h{k}, 2.2250738585072014e-308) / greatest(t{k}, 1))' for k in range(1, n + 1))}) / {n}) END" for n in range(1, 5)}


@query(f"""WITH {_PT}, {_BEAMS}, n AS (SELECT unnest([1, 2, 3, 4]) AS n), g AS (SELECT conv_id, turn, rank, n, unnest(list_transform(range(1, CAST(len(w) - n + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram, 'p' AS side FROM bm, n UNION ALL
    SELECT conv_id, turn, rank, n, unnest(list_transform(range(1, CAST(len(t) - n + 2 AS BIGINT)), lambda i: array_to_string(t[i:i + n - 1], ' '))), 't' FROM bm, n),
    c AS (SELECT conv_id, turn, rank, n, gram, count(*) FILTER (WHERE side = 'p') AS a, count(*) FILTER (WHERE side = 't') AS b FROM g GROUP BY 1, 2, 3, 4, 5),
    s AS (SELECT rank, {', '.join(f'sum(CASE WHEN n = {n} THEN least(a, b) ELSE 0 END)::DOUBLE AS h{n}, sum(CASE WHEN n = {n} THEN a ELSE 0 END)::DOUBLE AS t{n}' for n in range(1, 5))} FROM c GROUP BY rank),
    l AS (SELECT rank, CASE WHEN sum(len(w)) > sum(len(t)) THEN 1 ELSE exp(1 - sum(len(t)) / greatest(sum(len(w)), 1)::DOUBLE) END AS bp FROM bm GROUP BY rank),
    v AS (SELECT s.rank, {', '.join(f'{e} AS {n}' for n, e in _BLEU.items())} FROM s JOIN l ON s.rank = l.rank), b AS (SELECT * FROM v ORDER BY bleu_4 DESC, rank LIMIT 1) {_values({n: n for n in _BLEU}, 'b')}""")
def eval_summary_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU-1 to BLEU-4 of the better of two beam places."""
    rows = _turns(spark, sf_dir, F.struct("conv_id", "turn"))
    return _rounded(V.evaluate(rows, "funcom_dataset", top_n=2))


@query(f"""WITH {_PT}, x AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'NO_BUG' ELSE 'POINTER(' || turn || ') ' || t[1] END AS target FROM pt),
    y AS (SELECT target, CASE conv_id % 4 WHEN 0 THEN target WHEN 1 THEN 'POINTER(' || turn || ') zz' WHEN 2 THEN 'NO_BUG' ELSE 'POINTER(99) ' || t[1] END AS pred FROM x),
    z AS (SELECT target <> 'NO_BUG' AS bug, pred = target AS same, string_split(pred, ' ') AS p, string_split(target, ' ') AS t FROM y),
    s AS (SELECT count(*) AS n, count(*) FILTER (WHERE bug) AS bugs, count(*) FILTER (WHERE same) AS same, count(*) FILTER (WHERE same AND bug) AS lr, count(*) FILTER (WHERE same AND NOT bug) AS free, count(*) FILTER (WHERE bug AND p[1] = t[1]) AS loc, count(*) FILTER (WHERE bug AND p[2:] = t[2:]) AS rep FROM z)
    {_values({'seq_acc': _RATIO.format('same', 'n'), 'loc_and_rep_acc': _RATIO.format('lr', 'bugs'), 'bug_free_class_acc': _RATIO.format('free', 'n - bugs'), 'loc_acc': _RATIO.format('loc', 'bugs'), 'rep_acc': _RATIO.format('rep', 'bugs')}, 's')}""")
def eval_misuse_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.concat(F.lit("POINTER("), i.cast("string"), F.lit(") "))
    rows = _pred(spark, sf_dir).withColumn("target", F.when(F.col("turn") % 3 == 0, "NO_BUG").otherwise(F.concat(at(F.col("turn")), F.element_at("t", 1))))
    k = F.col("conv_id") % 4
    guess = F.when(k == 0, F.col("target")).when(k == 1, F.concat(at(F.col("turn")), F.lit("zz"))).when(k == 2, "NO_BUG").otherwise(F.concat(at(F.lit(99)), F.element_at("t", 1)))
    return _rounded(V.evaluate(rows.select(F.array(guess).alias("beam"), "target"), "great_var_misuse_dataset"))


_OP5 = "['add_node', 'del_node', 'replace_val', 'replace_type', 'NoOp'][event_id % 5 + 1]"


@query(f"""WITH e AS (SELECT event_id, {_OP5} AS op, event_id % 3 = 0 AS hit FROM events), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE hit AND op <> 'NoOp') AS h, {', '.join(f"count(*) FILTER (WHERE op = '{o}') AS n_{o}, count(*) FILTER (WHERE hit AND op = '{o}') AS h_{o}" for o in ('add_node', 'del_node', 'replace_val', 'replace_type'))} FROM e)
    {_values({'total_acc': _RATIO.format('h', 'n'), **{m: _RATIO.format(f'h_{o}', f'n_{o}') for m, o in (('add_acc', 'add_node'), ('rep_val_acc', 'replace_val'), ('rep_type_acc', 'replace_type'), ('del_acc', 'del_node'))}}, 's')}""")
def eval_edit_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third edit is in the beam, in its second place; NoOp is in the total and never right."""
    op = F.element_at(F.array(*map(F.lit, ("add_node", "del_node", "replace_val", "replace_type", "NoOp"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(op == "NoOp", op).otherwise(F.concat(op, F.lit(" POINTER(1) "), "event_type")).alias("target"))
    rows = rows.withColumn("beam", F.array(F.lit("x"), F.when(F.col("event_id") % 3 == 0, F.col("target")).otherwise("y")))
    return _rounded(V.evaluate(rows, "hoppity_single_ast_diff_dataset"))


@query(f"WITH s AS (SELECT avg(CASE WHEN lang = 'en' OR lang = CASE WHEN doc_id % 3 = 0 THEN 'de' ELSE 'fr' END THEN 1.0 ELSE 0.0 END) AS a FROM documents) {_values({'class_acc': 'a'}, 's')}")
def eval_class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.array(F.lit("CLASS_en"), F.when(F.col("doc_id") % 3 == 0, "CLASS_de").otherwise("CLASS_fr")).alias("beam"), F.concat(F.lit("CLASS_"), "lang").alias("target"))
    return _rounded(V.evaluate(rows, "manysstubs4j_dataset"))


@query(f"""WITH x AS (SELECT CASE WHEN toxic = 1 THEN 'CLASS_Incorrect' ELSE 'CLASS_Correct' END AS c, CASE WHEN toxic = 1 - quality THEN 1 ELSE 0 END AS ok FROM labels), p AS (SELECT c, avg(ok) AS a, sum(ok) AS h, count(*) AS n FROM x GROUP BY c), s AS (SELECT sum(h) / sum(n)::DOUBLE AS a, avg(a) AS m FROM p)
    {_values({'accuracy': 'a', 'mean_per_class_accuracy': 'm'}, 's')} UNION ALL SELECT 'accuracy_' || c, round(a, 9) FROM p""")
def eval_known_class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks around predictions don't count."""
    rows = table(spark, sf_dir, "labels").select(F.array(F.when(F.col("quality") == 1, "  CLASS_Correct ").otherwise("CLASS_Incorrect\t")).alias("beam"), F.when(F.col("toxic") == 1, "CLASS_Incorrect").otherwise("CLASS_Correct").alias("target"))
    return _rounded(V.evaluate(rows, "cubert_function_docstring_classification_dataset"))


_REPAIR = """x AS (SELECT event_id % 4 + 1 AS a, CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id % 3 + 1 END AS b, event_id % 2 AS fa, user_id % 2 AS fb FROM events), y AS (SELECT *, coalesce(a = b AND fa = fb, false) AS same, coalesce(b <> 1, false) AS bug FROM x),
    s AS (SELECT count(*) AS n, count(*) FILTER (WHERE a <> 1) AS buggy, count(*) FILTER (WHERE b IS NULL) AS bad, count(*) FILTER (WHERE same) AS same, count(*) FILTER (WHERE bug AND a <> 1) AS tp, count(*) FILTER (WHERE b IS NOT NULL AND bug = (a <> 1)) AS tr, count(*) FILTER (WHERE bug AND a = b) AS loc, count(*) FILTER (WHERE bug AND same) AS rep FROM y)"""
_REPAIR_CELLS = {"total": "n", "total_buggy": "buggy", "true": _RATIO.format("tr", "n"), "sequence_accuracy": _RATIO.format("same", "n"), "true_positive": _RATIO.format("tp", "buggy"), "localized": _RATIO.format("loc", "buggy"), "localized_and_repaired": _RATIO.format("rep", "buggy"), "total_localized_but_not_repaired": "loc - rep", "total_syntax_errors": "bad"}


@query(f"WITH {_REPAIR} {_values({**_REPAIR_CELLS, 'raw_true': 'tr / 100000.0', 'raw_true_positive': 'tp / 50000.0', 'raw_localized': 'loc / 50000.0', 'raw_localized_and_repaired': 'rep / 50000.0'}, 's')}")
def eval_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs by pointer; every ninth user's prediction names no place."""
    e, u = F.col("event_id"), F.col("user_id")
    say = lambda at, fix: F.concat(F.lit("POINTER("), (at + 1).cast("string"), F.lit(",v) fix"), fix.cast("string"))
    rows = table(spark, sf_dir, "events").select(F.array(F.when(u % 9 == 0, "? POINTER(2,v)").otherwise(say(u % 3, u % 2))).alias("beam"), say(e % 4, e % 2).alias("target"))
    return _rounded(V.evaluate(rows, "cubert_variable_misuse_repair_dataset", raw_total=100_000, raw_total_buggy=50_000))


@query(f"WITH {_REPAIR} {_values(_REPAIR_CELLS, 's')}")
def eval_repair_unpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs by words."""
    e, u = F.col("event_id"), F.col("user_id")
    say = lambda at, fix: F.concat(F.when(at == 0, "BUG_FREE").otherwise(F.concat(F.lit("ERROR_LOCATION_"), (at + 1).cast("string"))), F.lit(" fix"), fix.cast("string"))
    rows = table(spark, sf_dir, "events").select(F.array(F.when(u % 9 == 0, "ERROR_LOCATION_1 x").otherwise(say(u % 3, u % 2))).alias("beam"), say(e % 4, e % 2).alias("target"))
    return _rounded(V.evaluate(rows, "cubert_variable_misuse_repair_unpointed_dataset"))


_TOKENS = "list_filter(string_split(replace(replace(regexp_replace(regexp_replace(regexp_replace({}, '([^A-Za-z0-9_])', ' \\1 ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'), '\"', '`'), '''', '`'), ' '), lambda x: x <> '')"


@query(f"""WITH {_PT}, {_BEAMS}, w AS (SELECT conv_id, turn, rank, unnest(range(greatest(len(w), len(t)))) AS i, w, t FROM bm), m AS (SELECT conv_id, turn, rank, i, CASE WHEN i < len(w) AND i < len(t) AND w[i + 1] = t[i + 1] THEN 1 ELSE 0 END AS ok FROM w),
    g AS (SELECT *, sum(1 - ok) OVER (PARTITION BY conv_id, turn, rank ORDER BY i) AS grp FROM m), r AS (SELECT conv_id, turn, rank, grp, sum(ok) AS n FROM g GROUP BY 1, 2, 3, 4), z AS (SELECT conv_id, turn, rank, count(*) AS total FROM m GROUP BY 1, 2, 3),
    x AS (SELECT r.conv_id, r.turn, r.rank, max(n) AS longest, sum(n * (n + 1)) / (2.0 * max(total)) AS expected FROM r JOIN z ON r.conv_id = z.conv_id AND r.turn = z.turn AND r.rank = z.rank GROUP BY 1, 2, 3),
    best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY expected DESC, rank) = 1),
    tk AS (SELECT conv_id, turn, {_TOKENS.format('ptext')} AS p, {_TOKENS.format('ttext')} AS t FROM pt), q AS (SELECT *, greatest(least(4, len(p), len(t)), 1) AS most FROM tk), n AS (SELECT unnest([1, 2, 3, 4]) AS n),
    gr AS (SELECT conv_id, turn, n, unnest(list_transform(range(1, CAST(len(p) - n + 2 AS BIGINT)), lambda i: array_to_string(p[i:i + n - 1], ' '))) AS gram, 'p' AS side FROM q, n UNION ALL SELECT conv_id, turn, n, unnest(list_transform(range(1, CAST(len(t) - n + 2 AS BIGINT)), lambda i: array_to_string(t[i:i + n - 1], ' '))), 't' FROM q, n),
    c AS (SELECT conv_id, turn, n, gram, count(*) FILTER (WHERE side = 'p') AS a, count(*) FILTER (WHERE side = 't') AS b FROM gr GROUP BY 1, 2, 3, 4), h AS (SELECT conv_id, turn, n, sum(least(a, b))::DOUBLE AS h FROM c GROUP BY 1, 2, 3),
    v AS (SELECT q.conv_id, q.turn, len(p) AS lp, len(t) AS lt, sum(CASE WHEN n.n = 1 THEN coalesce(h.h, 0) ELSE 0 END) AS h1, sum(CASE WHEN n.n <= most THEN ln(greatest(coalesce(h.h, 0), 2.2250738585072014e-308) / greatest(len(p) - n.n + 1, 1)) ELSE 0 END) / max(most) AS lg FROM q JOIN n ON true LEFT JOIN h ON h.conv_id = q.conv_id AND h.turn = q.turn AND h.n = n.n GROUP BY 1, 2, 3, 4),
    bl AS (SELECT avg(CASE WHEN lp = 0 AND lt = 0 THEN 100 WHEN lp = 0 OR h1 = 0 THEN 0 ELSE 100 * (CASE WHEN lp > lt THEN 1 ELSE exp(1 - lt / lp::DOUBLE) END) * exp(lg) END) AS bleu FROM v), s AS (SELECT avg(expected) AS e, avg(longest) AS l, max(bleu) AS bleu FROM best, bl)
    {_values({'average_expected_successive_tokens': 'e', 'average_max_successive_tokens': 'l', 'bleu': 'bleu'}, 's')}""")
def eval_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.evaluate(_turns(spark, sf_dir), "retrieve_and_edit_dataset"))


_COUNTERS = {f"num_{k}": k for k in ("element_correct", "element_attempts", "pointer_correct", "pointer_attempts", "toco_correct", "toco_attempts", "token_correct", "seq_correct", "seq_attempts", "pointer_seq_correct", "toco_seq_correct")}
_ACC = """e AS (SELECT user_id AS seq, event_id % 3 AS head, (event_id % 7) % 4 AS choice, event_id % 5 AS tok, CASE WHEN event_id % 11 = 0 THEN 2 ELSE -1 END AS ptr, CASE WHEN event_id % 2 = 0 THEN 3 ELSE -1 END AS cpy FROM events),
    r AS (SELECT *, tok <> 1 AS alive, ptr >= 0 AS po, CASE head WHEN 0 THEN choice = tok AND tok <> 0 AND ptr < 0 WHEN 1 THEN choice = cpy ELSE choice = ptr END AS ok FROM e),
    q AS (SELECT seq, count(*) FILTER (WHERE alive AND ok) AS ec, count(*) FILTER (WHERE alive) AS ea, count(*) FILTER (WHERE alive AND po AND ok) AS pc, count(*) FILTER (WHERE alive AND po) AS pa, count(*) FILTER (WHERE alive AND NOT po AND ok) AS tc, count(*) FILTER (WHERE alive AND NOT po) AS ta, count(*) FILTER (WHERE alive AND ok AND head = 0) AS kc FROM r GROUP BY seq),
    s AS (SELECT sum(ec) AS element_correct, sum(ea) AS element_attempts, sum(pc) AS pointer_correct, sum(pa) AS pointer_attempts, sum(tc) AS toco_correct, sum(ta) AS toco_attempts, sum(kc) AS token_correct, count(*) FILTER (WHERE ec = ea) AS seq_correct, count(*) AS seq_attempts, count(*) FILTER (WHERE pc = pa) AS pointer_seq_correct, count(*) FILTER (WHERE tc = ta) AS toco_seq_correct FROM q)"""


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as chosen outputs of their user's sequence."""
    i = F.col("event_id")
    none = F.array().cast("array<bigint>")
    head = F.element_at(F.array(F.lit("token"), F.lit("copy"), F.lit("pointer")), (i % 3 + 1).cast("int"))
    wanted = lambda c, v: F.when(c, F.array(F.lit(v).cast("bigint"))).otherwise(none)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), head.alias("head"), ((i % 7) % 4).alias("choice"), (i % 5).alias("token_id"), wanted(i % 2 == 0, 3).alias("copies"), wanted(i % 11 == 0, 2).alias("pointers"))


@query(f"WITH {_ACC} {_values(_COUNTERS, 's')}")
def eval_output_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of right tokens, copies and pointers, by place and by sequence."""
    return _rounded(V.output_accuracy(_choices(spark, sf_dir)))


@query(f"WITH {_ACC} SELECT place, line FROM (SELECT 0 AS place, 'seq_accuracy,' || format('{{:.5f}}', seq_correct / seq_attempts::DOUBLE) AS line FROM s UNION ALL SELECT 1, 'element_accuracy,' || format('{{:.5f}}', element_correct / element_attempts::DOUBLE) FROM s UNION ALL SELECT 2, 'num_sequences,' || seq_attempts FROM s UNION ALL SELECT 3, 'num_elements,' || element_attempts::BIGINT FROM s)")
def eval_accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.accuracy_report(V.output_accuracy(_choices(spark, sf_dir)))


@query("WITH s AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS c, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS a FROM labels GROUP BY 1) SELECT c || ': ' || format('{:.5f}', a::DOUBLE) AS line FROM s UNION ALL SELECT 'total: ' || count(*) FROM labels")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as lines of a report."""
    per = table(spark, sf_dir, "labels").groupBy(F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("metric")).agg(F.avg("quality").alias("value"))
    return V.report(per).union(table(spark, sf_dir, "labels").agg(F.format_string("total: %d", F.count(F.lit(1))).alias("line")))


_DRAW = "('0x' || substr(md5('boot:' || {} || ':' || {}), 1, 13))::BIGINT"


@query(f"""WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END AS ok FROM labels), n AS (SELECT count(*) AS n FROM labels),
    d AS (SELECT s, {_DRAW.format("CAST(s AS VARCHAR)", "CAST(idx AS VARCHAR)")} % n AS at FROM l, n, range(50) r(s)), v AS (SELECT s, avg(ok) AS v FROM d JOIN l ON l.idx = d.at GROUP BY s), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM v)
    SELECT 'class_acc' AS metric, ci, round(min(v) FILTER (WHERE k = lo), 9) AS lower, round(min(v) FILTER (WHERE k = hi), 9) AS upper FROM o, (VALUES (80, {bootstrap_bounds(50, 80)[0]}, {bootstrap_bounds(50, 80)[1]}), (90, {bootstrap_bounds(50, 90)[0]}, {bootstrap_bounds(50, 90)[1]})) c(ci, lo, hi) GROUP BY ci""")
def eval_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of class accuracy over 50 samples of the labelled documents, drawn by MD5."""
    from graphprep.operators.builders import running_starts

    def draw(sample: F.Column, at: F.Column, n: int) -> F.Column:
        said = F.md5(F.concat_ws(":", F.lit("boot"), sample.cast("string"), at.cast("string")))
        return F.pmod(F.conv(F.substring(said, 1, 13), 16, 10).cast("bigint"), F.lit(n))

    rows = table(spark, sf_dir, "labels").select("doc_id", F.array(F.col("quality").cast("string")).alias("beam"), (1 - F.col("toxic")).cast("string").alias("target"), F.lit(1).alias("one"))
    found = V.bootstrap(running_starts(rows, "doc_id", "one", "idx").drop("one"), V.class_accuracy, 50, (80, 90), draw=draw)
    return found.select("metric", "ci", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


@counted
def eval_bootstrap_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of all name metrics of turns over 100 samples, in one pass over blocks of turns."""
    return V.bootstrap_in_blocks(_turns(spark, sf_dir), V.name_prf, 100, (80, 95))
