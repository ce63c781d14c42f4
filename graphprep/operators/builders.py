"""Graph builders: raw rows to examples (nodes, edges, output). Every added edge has a reversed twin behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphprep.functions.text import escape, java_tokens, label_class, node, pair_lengths, parse_edit, patch_side, pointer, token, truncate
from graphprep.schema import EDGE, NODE, OUTPUT, REVERSED


def edge(src: Column, dst: Column, kind: Column) -> Column:
    return F.struct(src.cast("int").alias("src"), dst.cast("int").alias("dst"), kind.alias("type")).cast(EDGE)


def both_ways(edges: Column) -> Column:
    """Each edge and its reversed twin, in turn. Edges must be distinct: chains and trees are, given ones see given_graph()."""
    return F.flatten(F.transform(edges, lambda e: F.array(e, edge(e["dst"], e["src"], F.concat(F.lit(REVERSED), e["type"])))))


def settled(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with these columns computed here, once. Spark writes what makes a column into each of its uses, and arrays that lambdas
    make are then made again for each, and in filters below the shuffle that deals the rows out. It does neither across a generator."""
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline(F.array(F.struct(*columns)))).select(*rows.columns)


def token_nodes(tokens: Column, kind: str = "TOKEN", start: Column | None = None) -> Column:
    shift = F.lit(0) if start is None else start
    return F.transform(tokens, lambda t, i: node(i + shift, F.lit(kind), escape(t)))


def chain(n: Column, kind: str, start: Column | None = None) -> Column:
    """Edges i -> i + 1 over n nodes from `start` on."""
    shift = F.lit(0) if start is None else start
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: edge(i + shift, i + shift + 1, F.lit(kind)))).otherwise(F.array().cast(f"array<{EDGE}>"))


def chain_both_ways(n: Column, kind: str) -> Column:
    """both_ways(chain(n, kind)) in one step."""
    ways = lambda i: F.array(edge(i, i + 1, F.lit(kind)), edge(i + 1, i, F.lit(REVERSED + kind)))
    return F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), ways))).otherwise(F.array().cast(f"array<{EDGE}>"))


def chain_edge_rows(rows: DataFrame, key: str, n: Column, kind: str = "NEXT_TOKEN") -> DataFrame:
    """The edges of chains over n nodes, both ways, in long form: rows (key, src, dst, type), without the nodes. A chain's edges follow
    from its size alone."""
    first = F.explode_outer(F.when(n > 1, F.sequence(F.lit(0), n - 2)))  # inner would compute n once more below what comes before
    step = rows.select(key, first.alias("src")).where("src is not null")
    ways = F.array(edge(F.col("src"), F.col("src") + 1, F.lit(kind)), edge(F.col("src") + 1, F.col("src"), F.lit(REVERSED + kind)))
    return step.select(key, F.inline(ways))


def parent_graph(parents: DataFrame, children: DataFrame, key: str, edge_type: str = "HAS") -> DataFrame:
    """Examples of a parent (key, type, label), node 0, and its children (key, id, type, label), nodes by their ids from 1 on.

    Children are read once: of repeated ids the least type and label count, and edges follow from the nodes. Children without a parent
    drop out.
    """
    once = children.repartition(key).groupBy(key, "id").agg(F.min(F.struct("type", "label")).alias("x"))
    held = once.groupBy(key).agg(F.array_sort(F.collect_list(node(F.col("id"), F.col("x.type"), escape(F.col("x.label"))))).alias("_children"))
    found = parents.join(held, key, "left").withColumn("_children", F.coalesce("_children", F.array().cast(f"array<{NODE}>")))
    top = F.array(node(F.lit(0), F.col("type"), escape(F.col("label")))).cast(f"array<{NODE}>")
    edges = both_ways(F.transform("_children", lambda x: edge(F.lit(0), x["id"], F.lit(edge_type))))
    found = found.withColumns({"nodes": F.concat(top, "_children"), "edges": edges, "output": F.array().cast(f"array<{OUTPUT}>")})
    return with_sizes(found.drop("_children", "type", "label"))


def with_sizes(examples: DataFrame) -> DataFrame:
    """Scalars that filters and statistics read, so that they reach the scan of stored examples."""
    return examples.withColumns({"n_nodes": F.size("nodes"), "n_edges": F.size("edges"), "n_output": F.size("output"), "n_edge_types": F.size(F.array_distinct("edges.type"))})


def chain_examples(rows: DataFrame, tokens: Column, output: Column, kind: str = "NEXT_TOKEN") -> DataFrame:
    """A chain of TOKEN nodes. Null or empty token lists give an example without nodes."""
    found = rows.withColumn("_tokens", F.coalesce(tokens, F.array().cast("array<string>")))
    found = found.withColumns({"nodes": token_nodes(F.col("_tokens")), "edges": chain_both_ways(F.size("_tokens"), kind), "output": output.cast(f"array<{OUTPUT}>")})
    return with_sizes(found.drop("_tokens"))


def _hang(tokens: Column, top: Column, start: Column, kind: str) -> Column:
    return F.transform(tokens, lambda _, j: edge(top, j + start, F.lit(kind)))


def tree_examples(rows: DataFrame, sections: dict[str, Column], output: Column) -> DataFrame:
    """A root (id 0); for each section its tokens, chained, then a section root that the tokens and the root hang on."""
    found, start = rows, F.lit(1)
    nodes, edges = [F.array(node(F.lit(0), F.lit("ROOT"), F.lit("ROOT")))], []
    for i, (name, tokens) in enumerate(sections.items()):
        found = found.withColumn(f"_s{i}", F.coalesce(tokens, F.array().cast("array<string>")))
        n = F.size(f"_s{i}")
        top = start + n
        nodes += [token_nodes(F.col(f"_s{i}"), f"{name}_TOKEN", start), F.array(node(top, F.lit(name), F.lit(name)))]
        hang = _hang(F.col(f"_s{i}"), top, start, f"{name}_TOKEN")
        edges += [chain(n, f"NEXT_{name}_TOKEN", start), hang, F.array(edge(F.lit(0), top, F.lit(name)))]
        start = top + 1
    found = found.withColumns({"nodes": F.concat(*nodes), "edges": both_ways(F.concat(*edges)), "output": output})
    return with_sizes(found.drop(*[f"_s{i}" for i in range(len(sections))]))


def path_nodes(paths: Column) -> Column:
    """Nodes of an AST-path forest from an array of structs (start, ast, end), each an array of strings.

    Ids run over a root, then for each path: start subtokens, START_TOKEN, AST nodes, end subtokens, END_TOKEN, ROOT_AST_PATH.
    """
    part = lambda p: F.concat(
        F.transform(p["start"], lambda t: F.struct(F.lit("SUBTOKEN").alias("type"), t.alias("label"))),
        F.array(F.struct(F.lit("START_TOKEN").alias("type"), F.lit("START_TOKEN").alias("label"))),
        F.transform(p["ast"], lambda t: F.struct(F.lit("AST_NODE").alias("type"), t.alias("label"))),
        F.transform(p["end"], lambda t: F.struct(F.lit("SUBTOKEN").alias("type"), t.alias("label"))),
        F.array(F.struct(F.lit("END_TOKEN").alias("type"), F.lit("END_TOKEN").alias("label")), F.struct(F.lit("ROOT_AST_PATH").alias("type"), F.lit("ROOT_AST_PATH").alias("label"))),
    )
    every = F.concat(F.array(F.struct(F.lit("C2C_ROOT").alias("type"), F.lit("C2C_ROOT").alias("label"))), F.flatten(F.transform(paths, part)))
    return F.transform(every, lambda x, i: node(i, x["type"], escape(x["label"])))


def given_graph(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Examples from node rows (key, id, type, label) and edge rows (key, src, dst, type). Repeated edges count once."""
    n = nodes.groupBy(key).agg(F.array_sort(F.collect_list(node(F.col("id"), F.col("type"), escape(F.col("label"))))).alias("nodes"))
    e = edges.groupBy(key).agg(F.array_sort(F.collect_set(edge(F.col("src"), F.col("dst"), F.col("type")))).alias("edges"))
    none = F.array().cast(f"array<{EDGE}>")
    return with_sizes(n.join(e, key, "left").withColumn("edges", both_ways(F.coalesce("edges", none))).withColumn("output", F.array().cast(f"array<{OUTPUT}>")))


def repair_examples(rows: DataFrame, tokens: Column, is_candidate, output: Column) -> DataFrame:
    """A token chain whose nodes say whether they are repair candidates: is_candidate(tokens, token, index)."""
    found = rows.withColumn("_tokens", tokens)
    nodes = F.transform("_tokens", lambda t, i: node(i, F.lit("TOKEN"), escape(t), is_candidate(F.col("_tokens"), t, i)))
    return with_sizes(found.withColumns({"nodes": nodes, "edges": chain_both_ways(F.size("_tokens"), "NEXT_TOKEN"), "output": output}).drop("_tokens"))


def with_task(examples: DataFrame, task: Column) -> DataFrame:
    """A last node that names the task. It counts: examples for it must be built for one node less."""
    more = F.concat("nodes", F.array(node(F.size("nodes"), F.lit("task"), task)).cast(f"array<{NODE}>"))
    return with_sizes(examples.withColumn("nodes", more))


def flat_examples(rows: DataFrame, tokens: Column, most: int, output: Column) -> DataFrame:
    """Nodes without edges: [CLS], at most most - 2 tokens, [SEP]."""
    found = rows.withColumn("nodes", token_nodes(truncate(tokens, most)))
    return with_sizes(found.withColumns({"edges": F.array().cast(f"array<{EDGE}>"), "output": output}))


def two_sequence_examples(rows: DataFrame, first: Column, second: Column, most: int, output: Column, kinds: tuple[str, str] = ("DOCSTRING", "TOKEN")) -> DataFrame:
    """Two sequences cut to fit together with three delimiters; nodes without edges."""
    found = rows.withColumns({"_a": first, "_b": second})
    x, y = pair_lengths(F.size("_a"), F.size("_b"), most - 3)
    a = F.concat(F.array(F.lit("[CLS]_")), F.slice("_a", F.lit(1), x), F.array(F.lit("[SEP]_")))
    b = F.concat(F.slice("_b", F.lit(1), y), F.array(F.lit("[SEP]_")))
    nodes = F.concat(token_nodes(a, kinds[0]), token_nodes(b, kinds[1], x + 2))
    return with_sizes(found.withColumns({"nodes": nodes, "edges": F.array().cast(f"array<{EDGE}>"), "output": output}).drop("_a", "_b"))


def masked_repair_examples(rows: DataFrame, tokens: str, error: str, target: str, candidate: str, most: int, fix: Column | None = None, pointed: bool = True, copyable: bool = True) -> DataFrame:
    """Repair examples from masks over tokens: one place of error (0: free of bugs), places that hold the right token, and
    candidates. [CLS] shifts all places by one. Rows whose error or whose targets were all cut off drop out.

    fix: the subtokens of the right token, by default the one at the first right place. pointed, copyable: see repair_output().
    """
    n = F.least(F.size(tokens), F.lit(most - 2))
    at = lambda m: F.filter(F.transform(F.col(m), lambda v, i: F.when((v == 1) & (i < n), i)), lambda i: i.isNotNull())
    found = rows.withColumns({"_error": at(error), "_target": at(target), "_cand": at(candidate)})
    free = F.element_at("_error", 1) == 0
    found = found.where(F.size("_error") > 0).where(F.coalesce(free, F.lit(False)) | (F.size("_target") > 0))
    nodes = F.transform(truncate(F.col(tokens), most), lambda t, i: node(i, F.lit("TOKEN"), escape(t), F.array_contains("_cand", i - 1)))
    none = F.array().cast("array<string>")
    right = F.array(F.get(F.col(tokens), F.get("_target", F.lit(0)))) if fix is None else fix
    output = repair_output(F.element_at("_error", 1) + 1, F.when(free, none).otherwise(right), pointed, copyable)
    return with_sizes(found.withColumns({"nodes": nodes, "edges": F.array().cast(f"array<{EDGE}>"), "output": output}).drop("_error", "_target", "_cand"))


# ---- graphs given as data


def first_edges(edges: Column) -> Column:
    """The edges without repeats, each at its first place. Sorting finds them: comparing structs all with all would not scale."""

    def kept(s: Column) -> Column:
        same = lambda x, y: (x["src"] == y["src"]) & (x["dst"] == y["dst"]) & (x["type"] == y["type"])
        return F.filter(s, lambda x, k: (k == 0) | ~same(F.get(s, F.greatest(k - 1, F.lit(0))), x))

    placed = F.array_sort(F.transform(edges, lambda e, i: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["type"].alias("type"), i.alias("i"))))
    by_place = F.array_sort(F.transform(_once(placed, kept), lambda x: F.struct(x["i"], x["src"], x["dst"], x["type"])))
    return F.transform(by_place, lambda x: edge(x["src"], x["dst"], x["type"]))


def _once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def distinct_or_error(edges: Column, key: Column) -> Column:
    """The edges; an error where one is there twice."""
    names = F.transform(edges, lambda e: F.concat_ws("/", e["src"].cast("string"), e["dst"].cast("string"), e["type"]))
    return F.when(F.size(F.array_distinct(names)) == F.size(edges), edges).otherwise(F.raise_error(F.concat(F.lit("repeated edge in graph "), key.cast("string"))))


def path_examples(rows: DataFrame, paths: str, output: Column) -> DataFrame:
    """AST-path forests: nodes as path_nodes() numbers them. Paths are structs (start, ast, end) of arrays with at least one entry.

    Subtokens are chained and hang on the root of their token, AST nodes are chained; the token roots touch the first and
    the last AST node; a path's root holds both token roots and all AST nodes; the forest's root holds the paths' roots.
    """
    sizes = F.transform(paths, lambda p: F.size(p["start"]) + F.size(p["ast"]) + F.size(p["end"]) + 3)
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
    starts = F.aggregate(sizes, start, lambda s, n: F.struct((s["next"] + n).alias("next"), F.concat(s["at"], F.array(s["next"])).alias("at")))["at"]

    def tree(p: Column, o: Column) -> Column:
        s, a, e = F.size(p["start"]), F.size(p["ast"]), F.size(p["end"])
        top, ast = o + s, o + s + 1
        end = ast + a
        end_top = end + e
        root = end_top + 1
        hang = lambda tokens, at, first, kind: F.transform(tokens, lambda _, j: edge(at, first + j, F.lit(kind)))
        one = lambda x, y, kind: F.array(edge(x, y, F.lit(kind)))
        return F.concat(
            chain(s, "NEXT_SUBTOKEN", o), hang(p["start"], top, o, "SUBTOKEN"), chain(a, "NEXT_AST_NODE", ast), chain(e, "NEXT_SUBTOKEN", end), hang(p["end"], end_top, end, "SUBTOKEN"),
            one(top, ast, "START_AST_PATH"), one(end_top, end - 1, "END_AST_PATH"), one(root, top, "START_TOKEN"), one(root, end_top, "END_TOKEN"), hang(p["ast"], root, ast, "AST_NODE"), one(F.lit(0), root, "AST_PATH"),
        )

    found = rows.withColumn("_at", starts)
    edges = F.flatten(F.zip_with(F.col(paths), F.col("_at"), tree))
    return with_sizes(found.withColumns({"nodes": path_nodes(F.col(paths)), "edges": both_ways(edges), "output": output}).drop("_at"))


def misuse_examples(rows: DataFrame, tokens: str, edges: str, candidates: Column, has_bug: str, error: str, targets: str) -> DataFrame:
    """Given token graphs with a misused variable: a pointer to it and the right token, or NO_BUG.

    edges are structs (src, dst, type), repeats count once. Rows with a bug and no right place drop out; of several right
    places the first counts.
    """
    found = rows.where(~F.col(has_bug) | (F.size(targets) > 0)).withColumn("_cand", candidates)
    nodes = F.transform(F.col(tokens), lambda t, i: node(i, F.lit("TOKEN"), escape(t), F.array_contains("_cand", i)))
    given = F.transform(F.col(edges), lambda e: edge(e["src"], e["dst"], e["type"]))
    fix = token(F.get(F.col(tokens), F.get(F.col(targets), F.lit(0))))
    output = F.when(F.col(has_bug), F.array(pointer(F.col(error)), fix)).otherwise(F.array(token(F.lit("NO_BUG"))))
    return with_sizes(found.withColumns({"nodes": nodes, "edges": first_edges(both_ways(given)), "output": output}).drop("_cand"))


def edit_examples(rows: DataFrame, nodes: str, edges: str, script: Column) -> DataFrame:
    """Given syntax trees with an edit script as output. nodes are structs (id, type, value), edges (src, dst, type); repeats count once."""
    given = F.transform(F.col(edges), lambda e: edge(e["src"], e["dst"], e["type"].cast("string")))
    own = F.array_sort(F.transform(F.col(nodes), lambda n: node(n["id"], n["type"], escape(n["value"]))))
    return with_sizes(rows.withColumns({"_nodes": own, "_edges": first_edges(both_ways(given)), "output": parse_edit(script)}).drop("nodes", "edges").withColumnsRenamed({"_nodes": "nodes", "_edges": "edges"}))


def typed_chain_examples(rows: DataFrame, tokens: str, name: Column) -> DataFrame:
    """Chains of tokens that know their type, structs (type, label), with a class as output."""
    nodes = F.transform(F.col(tokens), lambda t, i: node(i, t["type"], escape(t["label"])))
    return with_sizes(rows.withColumns({"nodes": nodes, "edges": chain_both_ways(F.size(tokens), "NEXT_TOKEN"), "output": F.array(label_class(name))}))


def patch_examples(rows: DataFrame, patch: str, bug: Column) -> DataFrame:
    """Two examples for each unified diff of Java code: before it with the kind of bug, after it with NO_BUG.

    Patches with a side that is not Java drop out. Column side says which it is.
    """
    sides = rows.withColumns({"_before": java_tokens(patch_side(F.col(patch), False)), "_after": java_tokens(patch_side(F.col(patch), True)), "_bug": bug})
    sides = settled(sides, "_before", "_after")
    sides = sides.where((F.size("_before") > 0) & (F.size("_after") > 0))
    both = F.array(F.struct(F.lit("before").alias("side"), F.col("_before").alias("tokens"), F.col("_bug").alias("name")), F.struct(F.lit("after").alias("side"), F.col("_after").alias("tokens"), F.lit("NO_BUG").alias("name")))
    each = sides.withColumn("_x", F.explode(both)).withColumns({"side": F.col("_x.side"), "_tokens": F.col("_x.tokens"), "_name": F.col("_x.name")})
    return typed_chain_examples(each, "_tokens", F.col("_name")).drop("_before", "_after", "_bug", "_x", "_tokens", "_name")


def repair_output(error: Column, fix: Column, pointed: bool = True, copyable: bool = True) -> Column:
    """Output of a repair: where the error is (1: free of bugs), then the subtokens of the right token.

    pointed: as a pointer, else as the word BUG_FREE or ERROR_LOCATION_k. Unless copyable, the subtokens carry a mark that
    no node label has.
    """
    said = token(F.when(error == 1, "BUG_FREE").otherwise(F.concat(F.lit("ERROR_LOCATION_"), error.cast("string"))))
    mark = F.lit("" if copyable else "###DO_NOT_COPY_ME###")
    return F.concat(F.array(pointer(error) if pointed else said), F.transform(fix, lambda t: token(F.concat(mark, t))))


def random_letters(spark, n: int, least: int = 100, most: int = 1000, seed: int = 0) -> DataFrame:
    """Rows (graph, n_nodes, types, labels, pointer): what random_chains() makes its graphs of, in lists apart, so that a reader of one
    list makes no other."""
    draw = lambda what, *key: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *key), F.lit(1 << 40))
    rows = spark.range(n).withColumnRenamed("id", "graph").withColumn("n_nodes", (least + draw("size", F.col("graph")) % (most - least + 1)).cast("int"))
    letters = lambda what, first: F.transform(F.sequence(F.lit(0), F.col("n_nodes") - 1), lambda i: F.char(first + draw(what, F.col("graph"), i) % 26))
    return rows.withColumns({"types": letters("type", 65), "labels": letters("label", 97), "pointer": (draw("pointer", F.col("graph")) % F.col("n_nodes")).cast("int")})


def random_chains(spark, n: int, least: int = 100, most: int = 1000, seed: int = 0) -> DataFrame:
    """Chains of least to most nodes: types A-Z, labels a-z, even ids candidates; the token foo, a pointer to any node, the class 0.

    Hashes of (seed, graph, place) decide, so a graph is the same however the rows are dealt.
    """
    rows = random_letters(spark, n, least, most, seed)
    nodes = F.transform(F.arrays_zip("types", "labels"), lambda x, i: node(i, x["types"], x["labels"], i % 2 == 0))
    output = F.array(token(F.lit("foo")), pointer(F.col("pointer")), label_class(F.lit("0")))
    return with_sizes(rows.withColumns({"nodes": nodes, "edges": chain_both_ways(F.col("n_nodes"), "NEXT_NODE"), "output": output}).drop("types", "labels", "pointer"))


def running_starts(counts: DataFrame, order: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Sum of value over all rows before, in the order of an integer column, with no task holding all rows."""
    parts = counts.withColumn("_part", F.floor(F.col(order) / width))
    before = parts.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn(out, inside).join(before, "_part").withColumn(out, (F.col(out) + F.col("_before")).cast("bigint")).drop("_part", "_before")


def deal_rows(flat: DataFrame, place: str, counts: DataFrame, key: str, n: str, local: str) -> DataFrame:
    """Rows of a flat table with the graph they belong to and their number in it: graph after graph takes its count of rows.

    A range join by equality: each graph's places are written out and joined, so its cost is the flat table's size.
    """
    starts = running_starts(counts.select(key, n), key, n, "_start")
    places = starts.where(F.col(n) > 0).select(key, "_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1)).alias(local))
    return flat.join(places.select(key, local, (F.col("_start") + F.col(local)).alias(place)), place).drop(place)


#: Attributes of a bundle that are sent to all executors, and parts that the nodes of each of more are dealt to.
SENT_ATTRS, ATTR_PARTS = 100_000, 32


def bundle_examples(counts: DataFrame, node_rows: DataFrame, edge_rows: DataFrame, types: DataFrame, attrs: DataFrame) -> DataFrame:
    """Examples from a bundle of flat tables. counts: (graph, n_nodes, n_edges, name), graphs numbered from 0; node_rows: (place,
    type_id, attr_id); edge_rows: (place, src, dst); types: (type_id, type); attrs: (attr_id, label). Edges have the type EDGE,
    a repeated one is an error. Output: the words of name.

    Types and attributes are few and each is on many nodes: a shuffle by them would put all nodes of one into one task. Types, which
    a grammar bounds, are sent to all executors, attributes up to SENT_ATTRS of them. More of them meet the nodes in a shuffle by
    attribute and part, a part of an attribute's nodes to each task."""
    own = deal_rows(node_rows, "place", counts, "graph", "n_nodes", "id").join(F.broadcast(types), "type_id")
    if attrs.limit(SENT_ATTRS + 1).count() <= SENT_ATTRS:
        own = own.join(F.broadcast(attrs), "attr_id")
    else:
        parts = attrs.withColumn("_attr_part", F.explode(F.sequence(F.lit(0), F.lit(ATTR_PARTS - 1))))
        own = own.withColumn("_attr_part", F.pmod(F.xxhash64("graph", "id"), F.lit(ATTR_PARTS)).cast("int")).join(parts, ["attr_id", "_attr_part"]).drop("_attr_part")
    links = deal_rows(edge_rows, "place", counts, "graph", "n_edges", "at")
    nodes = own.groupBy("graph").agg(F.array_sort(F.collect_list(node(F.col("id"), F.col("type"), escape(F.col("label"))))).alias("nodes"))
    edges = links.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("at", edge(F.col("src"), F.col("dst"), F.lit("EDGE")).alias("e")))).alias("_edges"))
    found = counts.select("graph", "name").join(nodes, "graph").join(edges, "graph", "left")
    given = F.coalesce(F.col("_edges.e"), F.array().cast(f"array<{EDGE}>"))
    found = found.withColumn("edges", both_ways(distinct_or_error(given, F.col("graph"))))
    return with_sizes(found.withColumn("output", F.transform(F.split("name", " ", -1), token)).drop("_edges", "name"))
