"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by token-combination prefixes.

Tokens are 64-bit hashes of distinct n-word shingles. For sets x, y with |x and y| >= 0.9 |x or y| each has at most
floor(|x| / 10) tokens that the other lacks (for a threshold of 90 per cent; general below).

1. Documents with equal sets form one node; only nodes are compared.
2. A node with more tokens of its own (found in no other node) than it may lack has no partner. A first pass proves
   this for most documents on a share of the token space; it drops none that could have a partner.
3. For the rest, tokens are ordered by frequency, rare first, and classed: up to class_limits[0] nodes class 1, then
   class 2, ... Class-1 tokens are indexed one by one, class-k tokens in combinations of k. So that combinations stay
   few, tokens are dealt to G groups by their hash and only tokens of one group are combined: (k - 1) * G + 1 shared
   tokens have k in one group. The prefix is extended until tokens of class 1, plus all but G of class 2, plus all but
   2 * G of class 3 ... exceed the number that may be lacking; by the pigeonhole principle two linked sets then share
   an indexed combination. G follows the set's size in steps of four (partners of another step index for both), which
   makes the number of combinations about proportional to the size; sets below SINGLE_SIZE index single tokens only.
4. Index entries connect nodes to candidate groups. A group that fits a block is verified in one task, exactly and on
   whole sets; the task returns a spanning forest of its links rather than all pairs. A larger group is dealt to
   blocks. First every block meets the group's pivots (a bounded number of its nodes), which puts most near copies
   into few classes at a cost in proportion to the group. Then blocks are formed again by class and size, and only
   pairs of blocks are compared that hold different classes and whose sizes can reach the threshold. So copies of one
   text are never compared in pairs of blocks; what is, are nodes that no link has joined so far.

No list of an entry is ever expanded into pairs of rows, no group meets in one task, and nothing is capped.

Defined results: null text or text without words has an empty set (n_shingles 0), links with nothing, and is its own
component. A text with fewer words than n is one shingle. Rows are found again by id and text hash, null ids too: a
row without an id links like others and never names a component unless all ids of it are null. Repeated rows are in
one component. Sets are identified by a 64-bit hash of their sorted tokens.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, base_columns, worker_table
from .subwords import small_batches

#: A block holds about so many sets, and about so many tokens; a large group has about so many pivots.
BLOCK_SETS, BLOCK_TOKENS, PIVOTS = 768, 1_000_000, 64
#: Sets below this size index single tokens only.
SINGLE_SIZE = 64
#: Nodes to read again, and groups of several blocks, are broadcast up to so many (24 bytes each).
BROADCAST_NODES = 500_000
#: Words that one worker remembers, by bytes of their text.
WORD_BYTES = 4_000_000


class _WordHashes(dict):
    """Word hashes; emptied when the words in it have WORD_BYTES."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        if self.held > WORD_BYTES:
            self.clear()
            self.held = 0
        self.held += len(word)
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], n: int = 3) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text."""
    known = worker_table("word hashes", _WordHashes)
    for a, b in small_batches(texts):
        split = [t.lower().split() for t in texts[a:b]]
        sizes = [len(s) for s in split]
        w = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(split)), np.uint64, sum(sizes))
        h = np.zeros(len(w), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h[: len(w) - k] = _mix(h[: len(w) - k] + w[k:] * np.uint64(2 * k + 1) + np.uint64(k + 1))
            start = 0
            for s in sizes:
                if s >= n:
                    yield np.unique(h[start : start + s - n + 1].view(np.int64))
                elif s:
                    short = np.uint64(s)
                    for x in w[start : start + s]:
                        short = _mix(np.array([short + x * np.uint64(0x9E3779B97F4A7C15)], np.uint64))[0]
                    yield np.array([short], np.uint64).view(np.int64)
                else:
                    yield np.zeros(0, np.int64)
                start += s


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _node(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def set_table(docs: DataFrame, n: int, share: int) -> DataFrame:
    """docs (doc_id, text_hash, text) to (doc_id, text_hash, n_shingles, node, probe): tokens of one share of the token
    space, all if 1."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "n_shingles", "node", "probe"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                size, node, probe = [], [], []
                for s in shingle_sets(texts, n):
                    size.append(len(s))
                    node.append(_node(s) if len(s) else None)
                    probe.append(s if share == 1 else s[s % share == 0])
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), _lists(probe)]
                yield pa.RecordBatch.from_arrays(columns, names)

    columns = f"doc_id {id_type}, text_hash bigint, n_shingles bigint, node bigint, probe array<bigint>"
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, columns)


def regime(size: int) -> int:
    """0 below SINGLE_SIZE, then one more with every fourfold size."""
    return 0 if size < SINGLE_SIZE else 1 + ((size // SINGLE_SIZE).bit_length() - 1) // 2


def regime_groups(step: int, percent: int, extra: int) -> int:
    """G of a regime: about the tokens that its smallest sets may lack, and few enough for their prefixes."""
    if step == 0:
        return 0
    low = SINGLE_SIZE * 4 ** (step - 1)
    shared = -(-low * percent // 100)
    return max(1, min(low - shared, (shared - 1) // max(1, extra)))


def keys_of(tokens: np.ndarray, k: int, groups: int, tag: int) -> Iterator[np.ndarray]:
    """Hashes (int64, in parts of bounded size) of all combinations of k tokens of one group."""
    t = tokens.view(np.uint64)
    with np.errstate(over="ignore"):
        if k == 1:
            yield _mix(t + np.uint64(tag)).view(np.int64)
            return
        g = _mix(t) % np.uint64(groups)
        order = np.lexsort((t, g))
        t, g = t[order], g[order]
        if k == 2:
            for gap in range(1, len(t)):
                i = np.flatnonzero(g[gap:] == g[:-gap])
                if not len(i):
                    return  # groups lie together: no wider gap has a pair
                yield _mix(_mix(_mix(t[i]) + t[i + gap]) + np.uint64(tag)).view(np.int64)
            return
        for own in np.split(t, np.flatnonzero(g[1:] != g[:-1]) + 1):
            for some in itertools.batched(itertools.combinations(own.tolist(), k), 50_000):
                picks = np.array(some, np.uint64)
                keys = picks[:, 0]
                for c in range(1, k):
                    keys = _mix(_mix(keys) + picks[:, c])
                yield _mix(keys + np.uint64(tag)).view(np.int64)


def combination_keys(prefixes: DataFrame, groups_of: dict[int, int]) -> DataFrame:
    """(node, regime, k, tokens) to (key, node). Keys leave in parts, so a long prefix is never held with all of its
    combinations."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            for node, step, k, tokens in zip(f["node"].tolist(), f["regime"].tolist(), f["k"].tolist(), f["tokens"], strict=True):
                for keys in keys_of(np.asarray(tokens, np.int64), k, groups_of[step], 8 * step + k):
                    held.append((keys, np.full(len(keys), node, np.int64)))
                    size += len(keys)
                    if size > 100_000:
                        yield pd.DataFrame({"key": np.concatenate([x for x, _ in held]), "node": np.concatenate([y for _, y in held])})
                        held, size = [], 0
        if held:
            yield pd.DataFrame({"key": np.concatenate([x for x, _ in held]), "node": np.concatenate([y for _, y in held])})

    return prefixes.select("node", "regime", "k", "tokens").mapInPandas(run, "key bigint, node bigint")


def verify_blocks(sets: dict[int, np.ndarray], left: list[int], right: list[int] | None, percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the exact links between left and right nodes, or within left if right is None.

    known: classes that the nodes (left, then right) have from earlier links. Overlaps of one set with all others come from an inverted index of the block and one bincount. It ends when the
    nodes not yet compared are in one component (or, for two blocks, when one side has none left): every other pair
    has been compared. So a block of copies of one text takes a few comparisons, not one for each node.
    """
    nodes = left if right is None else [*left, *right]
    size = np.array([len(sets[v]) for v in nodes])
    tokens = np.concatenate([sets[v] for v in nodes])
    owner = np.repeat(np.arange(len(nodes)), size)
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    _, first, count = np.unique(tokens[order], return_index=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.repeat(np.arange(len(first)), count)
    starts = np.concatenate([[0], np.cumsum(size)])
    label = np.arange(len(nodes)) if known is None else np.unique(known, return_inverse=True)[1]  # class of each node
    open_ = np.ones(len(nodes), bool)  # not yet compared with all others
    n_left = len(nodes) if right is None else len(left)
    links = []
    while open_[:n_left].any() and (right is None or open_[n_left:].any()):
        sizes = np.bincount(label[open_], minlength=len(nodes))
        outside = np.flatnonzero(open_ & (label != sizes.argmax()))
        if not len(outside):
            break
        i = int(outside[0]) if len(outside) < np.count_nonzero(open_[:n_left]) else int(open_.argmax())
        open_[i] = False
        own = rank[starts[i] : starts[i + 1]]
        own = own[count[own] > 1]
        if not len(own):
            continue
        c = count[own]
        at = np.repeat(first[own] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        overlap = np.bincount(owner[at], minlength=len(nodes))
        linked = np.flatnonzero((100 * overlap >= percent * (size + size[i] - overlap)) & (label != label[i]))
        for j in linked.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((nodes[i], nodes[j]))
    return links


def _verify(percent: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, g in f.groupby("root", sort=False):
            sets = {v: np.asarray(t, np.int64) for v, t in zip(g["node"].tolist(), g["tokens"], strict=True)}
            left, right = g.loc[g["side"] == 0], g.loc[g["side"] == 1]
            known = [*left["label"].tolist(), *right["label"].tolist()]
            links += verify_blocks(sets, left["node"].tolist(), right["node"].tolist() or None, percent, known)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def _links(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """tasks (root, left, right, side, node, label): one Python call per (left, right)."""
    rows = sets.select("node", "tokens").join(_maybe_broadcast(tasks), "node")
    return rows.groupBy("left", "right").applyInPandas(_verify(percent), "a bigint, b bigint")


def linked_nodes(groups: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) links that connect what is linked within the candidate groups (node, root, n_shingles)."""
    extent = groups.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("n_shingles").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("nodes") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long")
    large = scratch.keep(extent.withColumn("blocks", blocks).filter("blocks > 1").select("root", "nodes", "blocks"), "large")
    dealt = scratch.keep(groups.join(_maybe_broadcast(large), "root", "left"), "dealt")
    # groups of one block share tasks
    total = dealt.filter("blocks is null").agg(F.sum("n_shingles")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("root"), F.lit(max(1, -(-total // BLOCK_TOKENS))))
    side, none = F.lit(0).alias("side"), F.lit(-1).cast("long")
    small = dealt.filter("blocks is null").select("root", bucket.alias("left"), none.alias("right"), side, "node", F.col("node").alias("label"))
    many = dealt.filter("blocks is not null").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pivot = F.pmod(F.xxhash64("node", F.lit(7)), F.greatest(F.lit(1), (F.col("nodes") / PIVOTS).cast("long"))) == 0
    of = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = many.select("root", F.explode(of).alias("block"), "node").select("root", F.xxhash64("root", "block").alias("left"), (none - 1).alias("right"), side, "node", F.col("node").alias("label"))
    links = scratch.keep(_links(small.unionByName(first), sets, percent), "links")
    if large.isEmpty():
        return links
    named = components(links.join(many.select(F.col("node").alias("a")), "a", "left_semi"), scratch, "classes")
    many = many.select("node", "root", "n_shingles").join(named.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    many = scratch.keep(many.withColumn("step", F.floor(F.log(F.col("n_shingles").cast("double")) / np.log(100 / min(percent, 99)) + 1e-9)), "many")
    big = many.groupBy("root", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= BLOCK_SETS).select("label", F.lit(True).alias("big"))
    many = many.join(big, "label", "left").withColumn("class", F.when(F.col("big"), F.col("label")))
    key = ["root", "class", "step"]
    cells = many.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_TOKENS)).cast("long").alias("pieces"))
    same = (F.col("c.root") == F.col("m.root")) & F.col("c.class").eqNullSafe(F.col("m.class")) & (F.col("c.step") == F.col("m.step"))
    piece = F.pmod(F.when(F.col("m.class").isNull(), F.xxhash64("m.label")).otherwise(F.xxhash64("m.node")), F.col("pieces"))
    placed = many.alias("m").join(_maybe_broadcast(cells).alias("c"), same).select("m.*", F.xxhash64("m.root", F.coalesce("m.class", F.lit(0)), "m.step", piece).alias("block"))
    placed = scratch.keep(placed.select("node", "root", "label", "class", "step", "block"), "placed")
    one = placed.select("root", "class", "step", "block").distinct()
    two = one.select("root", F.col("class").alias("class2"), F.col("step").alias("step2"), F.col("block").alias("right"), F.explode(F.array("step", F.col("step") - 1)).alias("step"))
    pairs = one.join(two, ["root", "step"]).filter("(step <> step2 or block <= right) and not coalesce(class = class2, false)")
    pairs = pairs.select("root", F.col("block").alias("left"), "right")
    sides = F.when(F.col("left") == F.col("right"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    sided = pairs.withColumn("side", F.explode(sides)).withColumn("block", F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right")))
    tasks = sided.join(placed.select("node", "label", "block"), "block").select("root", "left", "right", "side", "node", "label")
    return links.unionByName(scratch.keep(_links(tasks, sets, percent), "more_links"))


def classes(docs: DataFrame, n: int = 3, percent: int = 90, class_limits: tuple[int, ...] = (256,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, root, component_id) for every row of docs; root names the class, null for an
    empty set."""
    docs = base_columns(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    lacking = lambda size: size - (size * percent + 99) // 100
    own = F.expr(f"n_shingles - (n_shingles * {percent} + 99) div 100")  # tokens that a partner may lack
    with Scratch(docs.sparkSession) as scratch:
        # the share of the token space must show more tokens of its own than may be lacking: it holds 1.7 times as many
        table = scratch.keep(set_table(docs, n, max(1, 60 // max(1, 100 - percent))), "shingles")

        # step 2: tokens that only one node has
        # (min and max over nodes: equal copies of one set don't make its tokens common)
        tokens = table.filter("node is not null").select("node", F.explode("probe").alias("token"))
        single = tokens.groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other").groupBy("node").agg(F.count("*").alias("alone"))
        # below this size no different set can reach the threshold
        least = next(s for s in itertools.count(1) if lacking(s) > 0 or 100 * s >= percent * (s + 1)) if percent < 100 else 1 << 62
        nodes = table.filter(f"node is not null and n_shingles >= {least}").groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("row"), F.min("n_shingles").alias("n_shingles"))
        able = nodes.join(single, "node", "left").filter(F.coalesce("alone", F.lit(0)) <= own).select("node", "row.text_hash", "row.doc_id")
        able = scratch.keep(able, "able", release=True)
        rows_of = scratch.keep(table.drop("probe"), "rows")
        scratch.drop(table)

        # step 3: whole sets of the rest, read again from one row of each. Equal rows give a set twice.
        wanted = able.select(F.col("text_hash").alias("h"), F.col("doc_id").alias("i"))
        few = able.count()
        wanted = F.broadcast(wanted) if few <= BROADCAST_NODES else wanted
        again = docs.join(wanted, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
        sets = set_table(again, n, 1).select("node", "n_shingles", F.col("probe").alias("tokens"))
        sets = scratch.keep(sets, "sets", release=True)
        if sets.count() > few:
            repeated, sets = sets, scratch.keep(sets.dropDuplicates(["node"]), "sets")
            scratch.drop(repeated)
        scratch.drop(able)
        rows = sets.select("node", "n_shingles", F.explode("tokens").alias("token"))
        frequency = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
        shared = rows.join(frequency, "token")
        extra = sum(range(len(class_limits) + 1))
        step = lambda x: F.when(x < SINGLE_SIZE, F.lit(0)).otherwise(1 + ((F.length(F.bin((x / SINGLE_SIZE).cast("long"))) - 1) / 2).cast("int"))
        per_node = shared.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
        per_node = per_node.withColumn("need", own + 1 - (F.col("n_shingles") - F.size("t"))).filter("need > 0")
        low, high = F.expr(f"(n_shingles * {percent} + 99) div 100"), F.expr(f"n_shingles * 100 div {percent}")
        per_node = per_node.withColumn("regime", F.explode(F.sequence(step(low), step(high))))
        groups_of = {r: regime_groups(r, percent, extra) for r in range(20)}
        longest = F.element_at(F.create_map(*[F.lit(x) for r, g in groups_of.items() for x in (r, g * extra)]), F.col("regime"))
        per_node = per_node.withColumn("t", F.slice("t", 1, (F.col("need") + longest).cast("int")))
        k = F.lit(len(class_limits) + 1)
        for i, limit in reversed(list(enumerate(class_limits))):
            k = F.when(F.col("x.df") <= limit, i + 1).otherwise(k)
        k = F.when(F.col("regime") == 0, 1).otherwise(k)
        prefix = per_node.select("node", "regime", F.explode("t").alias("x")).select("node", "regime", k.alias("k"), F.col("x.token").alias("token"))
        prefix = prefix.groupBy("node", "regime", "k").agg(F.collect_list("token").alias("tokens"))
        entries = scratch.keep(combination_keys(prefix, groups_of), "entries", release=True)
        heads = entries.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
        near = entries.join(heads.select("key", "head"), "key").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))

        # step 4: candidate groups, blocks, verification
        groups = components(near, scratch, "candidates")
        scratch.drop(entries)
        groups = scratch.keep(groups.join(sets.select("node", "n_shingles"), "node"), "groups")
        roots = components(linked_nodes(groups, sets, percent, scratch), scratch, "linked")

        # the smallest id of each component; a node without links is its own
        members = rows_of.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = members.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest"))
        out = members.join(smallest, "root", "left")
        component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id")
        return scratch.release(scratch.keep(out.select("doc_id", "text_hash", "n_shingles", "root", component), "classes"))


def similar_components(docs: DataFrame, n: int = 3, percent: int = 90, class_limits: tuple[int, ...] = (256,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    percent: link when 100 * intersection >= percent * union. class_limits: highest frequency of class 1, 2, ...;
    tokens beyond the last are of one more class.
    """
    return classes(docs, n, percent, class_limits, id_col, text_col).select("doc_id", "n_shingles", "component_id")
