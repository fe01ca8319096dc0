"""Join of documents by the Jaccard similarity of their word n-grams, with prefix trees.

1. Each text becomes the set of its distinct ``size``-word shingles, as ordered
   64-bit hashes. Equal sets are one node from here on, named by a hash of the set.
2. The order of the hashes is cut into parts, more of them than two linked sets
   can differ in elements, so linked sets agree on a whole part: in a trie that
   begins with that part they lie below one path. A node is sent to the key of
   each of its paths (one row of two longs), for its length class and the next
   shorter one. Keys that a task meets twice are merged there before the shuffle.
3. Nodes that share a key are joined into candidate blocks; a block is an upper
   bound of the components in it.
4. Each node of a block is compared with one other, the least one that it shares a
   key with. That labels most of a group of near copies at a cost in proportion to their
   texts; a large star is cut into pieces, and its middle goes to each.
5. A block whose nodes all have one label is settled. In the others, the nodes of
   the label with the most elements meet all other nodes, and the others meet one another,
   in tasks of chunks of about ``CHUNK_ELEMENTS`` elements, and are joined by
   ``prefix_tree.Trie``, which finds every link between nodes that aren't known to be connected.
6. Links become components. Rows that leave a task are a label a node.

So a group of near copies, however large, is sent to tasks a fixed number of times.
What grows with the square of a block is the meeting of its other nodes if they are more than
a chunk: many texts that are no copies but share keys. ``count_links`` counts the links of
each document, too; then no pair may be left out, and each chunk of a block meets each other.

Two sets link when ``den * overlap >= num * union``. Defined cases: a text with
fewer words than ``size`` is one shingle, its whole word sequence; a null text or
one without words has an empty set and links with nothing. Documents with equal
sets are linked. A null id never is a component_id unless no member has an id.
Repeated rows are documents of their own. Of an empty table the result is empty. Other
columns are left out, or kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .prefix_tree import Trie, _spread, least_labels
from .runtime import documents, lean, passing, row_of, tidy, written

SIZE, NUM, DEN = 3, 90, 100
#: A part of fewer elements says little; nodes send it only if too few of their parts have more.
WEAK = 4
#: Texts of the sample that popular shingles are told from, about, and texts of it that have one.
POPULAR_SAMPLE, POPULAR = 20_000, 3
#: Elements of a chunk of a large block, about: what a task holds of it is twice that.
CHUNK_ELEMENTS = 150_000
#: Elements that are joined in one trie forest, about, if blocks are small.
FOREST_ELEMENTS = 400_000
#: Elements of a piece of a star, about.
STAR_ELEMENTS = 20_000
#: Popular shingles that are broadcast at most; which ones only decides how large blocks become.
MAX_POPULAR = 2_000_000


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of distinct shingles of each text, and their hashes in ascending order, text after text."""
    n = len(off) - 1
    low = tb.lowered(data)
    starts, ends = tb.runs(~tb.SPACE[low], off)
    text = tb.text_of(starts, off)
    words = tb.run_hashes(low, starts, ends)
    per_text = tb.count_by_text(text, n)
    hashes, begin = tb.windows(words, text, size)
    of = text[begin]
    first = np.cumsum(per_text) - per_text
    for short in range(1, size):
        which = np.flatnonzero(per_text == short)
        if len(which):
            h = tb.mix(words[first[which]] + np.uint64(short))
            for k in range(1, short):
                h = tb.mix(h ^ words[first[which] + k])
            hashes, of = np.concatenate([hashes, h]), np.concatenate([of, which])
    order = np.argsort(hashes)
    small = np.uint16 if n < 1 << 16 else np.uint32
    order = order[np.argsort(of[order].astype(small), kind="stable")]
    hashes, of = hashes[order], of[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return tb.count_by_text(of[keep], n), hashes[keep]


def node_names(lens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty set."""
    out = np.zeros(len(lens), dtype=np.uint64)
    full = np.flatnonzero(lens)
    if len(full):
        at = (np.cumsum(lens) - lens)[full]
        out[full] = tb.mix(np.add.reduceat(tb.mix(hashes ^ np.uint64(0x5E7)), at) + lens[full].astype(np.uint64))
    return out


class Levels:
    """Length classes: sets that may link lie in one class or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]

    def _grow(self, n: int) -> None:
        while self.bounds[-1] <= n:
            self.bounds.append(self.den * self.bounds[-1] // self.num + 1)

    def of(self, lens: np.ndarray) -> np.ndarray:
        self._grow(int(lens.max(initial=1)))
        return np.searchsorted(np.array(self.bounds), lens, side="right") - 1

    def differ(self, level: int) -> int:
        """In how many elements two linked sets can differ whose shorter one has this level."""
        self._grow(self.bounds[level] if level < len(self.bounds) else 1)
        while len(self.bounds) < level + 2:
            self._grow(self.bounds[-1])
        short = self.bounds[level + 1] - 1
        return (self.den - self.num) * (short + self.den * short // self.num) // (self.den + self.num)


def path_keys(lens: np.ndarray, hashes: np.ndarray, levels: Levels, popular: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the number of the set that has each. The sets must not be empty.

    popular: sorted hashes of elements that many sets have. Without them two sets
    differ in no more elements, so they still agree on as many parts, and a part of
    one element that is left says enough. Sets that have too few others send the
    keys of all their elements besides.
    """
    if not len(lens):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    own = levels.of(lens)
    everything = np.arange(len(lens))
    if popular is None:
        keys, owners, _ = _part_keys(own, everything, lens, hashes, levels, WEAK, True, 0)
        return keys, owners
    place = np.minimum(np.searchsorted(popular, hashes), max(0, len(popular) - 1))
    rare = popular[place] != hashes if len(popular) else np.ones(len(hashes), dtype=bool)
    left = np.bincount(np.repeat(everything, lens)[rare], minlength=len(lens))
    keys, owners, thin = _part_keys(own, everything, left, hashes[rare], levels, 1, False, 1)
    start = np.cumsum(lens) - lens
    more, of, _ = _part_keys(own[thin], thin, lens[thin], hashes[_spread(start[thin], lens[thin])], levels, WEAK, True, 2)
    return np.concatenate([keys, more]), np.concatenate([owners, of])


def _part_keys(own: np.ndarray, names: np.ndarray, lens: np.ndarray, hashes: np.ndarray, levels: Levels, weak_below: int, send_weak: bool, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of parts with at least weak_below elements, their sets, and the sets with too few such parts, which send the others only if send_weak."""
    keys, owners, thin = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    start = np.cumsum(lens) - lens
    mixed = tb.mix(hashes ^ np.uint64(0x9A27 + space))
    for down in (0, 1):
        level = own - down
        apart = np.array([levels.differ(x) if x >= 0 else 0 for x in range(-1, int(own.max(initial=0)) + 1)])[level + 1]
        sets = np.flatnonzero(apart > 0)  # where linked sets can't differ, they are one node
        if not len(sets):
            continue
        spare = -(-apart[sets] // 10)
        parts = apart[sets] + 1 + spare
        at = _spread(start[sets], lens[sets])
        element_set = np.repeat(np.arange(len(sets)), lens[sets])
        part = ((hashes[at] >> np.uint64(32)) * parts[element_set].astype(np.uint64)) >> np.uint64(32)
        offset = np.cumsum(parts) - parts
        slot = offset[element_set] + part.astype(np.int64)
        total = int(parts.sum())
        count = np.bincount(slot, minlength=total)
        value = np.zeros(total, dtype=np.uint64)
        if len(slot):
            begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            value[slot[begin]] = np.add.reduceat(mixed[at], begin)
        slot_set = np.repeat(np.arange(len(sets)), parts)
        weak = np.bincount(slot_set, weights=count < weak_below, minlength=len(sets))
        send = count >= weak_below
        if send_weak:
            send = send | (weak > spare)[slot_set]
        place = (level[sets][slot_set].astype(np.uint64) << np.uint64(32)) | (np.arange(total) - offset[slot_set]).astype(np.uint64)
        keys.append(tb.mix(value[send] + tb.mix(place[send] ^ np.uint64(space << 60))))
        owners.append(names[sets[slot_set[send]]])
        thin.append(names[sets[weak > spare]])
    return np.concatenate(keys), np.concatenate(owners), np.unique(np.concatenate(thin))


def merged_keys(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of key and node in which a key stands once: what shared it is tied to its least node by keys of their own."""
    if not len(keys):
        return keys, nodes
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    head = np.flatnonzero(first)
    # the least as Spark has it, which knows signed longs only
    least = np.minimum.reduceat(nodes.view(np.int64), head).view(np.uint64)
    of = least[np.cumsum(first) - 1]
    tie = of != nodes
    pairs = np.unique(np.stack([of[tie], nodes[tie]]), axis=1)
    own = tb.mix(pairs[0] + tb.mix(pairs[1]))
    return np.concatenate([keys[head], own, own]), np.concatenate([least, pairs[0], pairs[1]])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, node and n_shingles of each row of doc_id, text_key, text."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in tb.slices(batch.column(2)):
                lens, hashes = shingle_sets(data, off, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), _signed(node_names(lens, hashes)), pa.array(lens)], names=["doc_id", "text_key", "node", "n_shingles"])

    return docs.mapInArrow(lean(run), "doc_id long, text_key long, node long, n_shingles long")


def popular_shingles(docs: DataFrame, size: int, n_docs: int) -> np.ndarray:
    """Sorted hashes of shingles that several of at most about ``POPULAR_SAMPLE`` different texts have.

    They are left out of keys, which costs no link whatever they are; they only
    decide how large candidate blocks become. So a sample of texts (by hash) will do, and
    of its shingles the ``MAX_POPULAR`` most frequent ones.
    """

    def run(batches):
        for batch in batches:
            found = [shingle_sets(data, off, size)[1] for _, _, data, off in tb.slices(batch.column(0))]
            if found:
                shingles, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(shingles), pa.array(count)], names=["shingle", "n"])

    sample = docs.where(F.pmod(F.col("text_key"), F.lit(max(1, n_docs // POPULAR_SAMPLE))) == 0).dropDuplicates(["text_key"]).select("text")
    rows = sample.mapInArrow(lean(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= POPULAR).orderBy(F.desc("n"), "shingle").limit(MAX_POPULAR)
    with tidy(docs.sparkSession):
        rows = rows.select("shingle").toArrow()
    return np.sort(rows["shingle"].to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, dtype=np.uint64)


def key_table(docs: DataFrame, size: int, num: int, den: int, popular: np.ndarray | None = None) -> DataFrame:
    """key and node, a row for each path of each different set of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(popular)

    def run(batches):
        levels = Levels(num, den)
        for batch in batches:
            keys, nodes = [], []
            for _, _, data, off in tb.slices(batch.column(0)):
                lens, hashes = shingle_sets(data, off, size)
                names = node_names(lens, hashes)
                start = np.cumsum(lens) - lens
                _, first = np.unique(names, return_index=True)
                first = first[lens[first] > 0]
                k, owner = path_keys(lens[first], hashes[_spread(start[first], lens[first])], levels, shared.value)
                keys.append(k)
                nodes.append(names[first][owner])
            if keys:
                k, v = np.concatenate(keys), np.concatenate(nodes)
                k, v = merged_keys(k, v)
                yield pa.RecordBatch.from_arrays([_signed(k), _signed(v)], names=["key", "node"])

    return docs.select("text").mapInArrow(lean(run), "key long, node long")


def star_links(stars: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """node and hub of the nodes that link with the hub of their star.

    stars: hub, piece, place (0 for the hub itself, 1 for others), node and text, in the
    order of the first three. Only the hub's set is held while its star passes.
    """

    def run(batches):
        held = None  # hub, piece, place and set of the star that is passing
        for batch in batches:
            table = pa.Table.from_batches([batch])
            columns = [table[x].to_numpy() for x in ("hub", "piece", "place", "node")]
            for lo, hi, data, off in tb.slices(table["text"]):
                lens, hashes = shingle_sets(data, off, size)
                hub, piece, place, node = (c[lo:hi] for c in columns)
                if held is not None:
                    hub, piece, place, node = (np.concatenate([[x], c]) for x, c in zip((*held[:3], held[0]), (hub, piece, place, node)))
                    lens, hashes = np.concatenate([[len(held[3])], lens]), np.concatenate([held[3], hashes])
                head = np.concatenate([[True], (hub[1:] != hub[:-1]) | (piece[1:] != piece[:-1])])
                star, heads = np.cumsum(head) - 1, np.flatnonzero(head)
                row = np.repeat(np.arange(len(lens)), lens)
                key = tb.mix(hashes ^ tb.mix(star[row].astype(np.uint64)))
                middle = np.sort(key[head[row]])
                hit = middle[np.minimum(np.searchsorted(middle, key), max(0, len(middle) - 1))] == key if len(middle) else np.zeros(len(key), dtype=bool)
                overlap = np.bincount(row, weights=hit, minlength=len(lens)).astype(np.int64)
                linked = (place == 1) & (place[heads][star] == 0) & (den * overlap >= num * (lens + lens[heads][star] - overlap))
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(hub[linked])], names=["node", "hub"])
                first, start = heads[-1], np.cumsum(lens) - lens
                held = (hub[-1], piece[-1], place[first], hashes[start[first] : start[first] + lens[first]])

    return stars.mapInArrow(lean(run), "node long, hub long")


def _join_blocks(table: pa.Table, size: int, num: int, den: int, count_links: bool) -> pa.RecordBatch:
    """node, label and (if asked for) the number of linked documents in the other nodes, for whole blocks."""
    node = table["node"].to_numpy().view(np.uint64)
    block = np.unique(np.stack([table[x].to_numpy() for x in ("root", "i", "j")]), axis=1, return_inverse=True)[1].ravel()
    lens, hashes = [], []
    for _, _, data, off in tb.slices(table["text"]):
        n, h = shingle_sets(data, off, size)
        lens.append(n)
        hashes.append(h)
    lens, hashes = np.concatenate(lens), np.concatenate(hashes)
    # a set once in a block, and only if the text still is the node's
    _, first = np.unique(np.stack([block.astype(np.uint64), node]), axis=1, return_index=True)
    keep = np.sort(first[node_names(lens, hashes)[first] == node[first]])
    start = np.cumsum(lens) - lens
    block, node, chunk, label = block[keep], node[keep], table["chunk"].to_numpy()[keep], table["label"].to_numpy()[keep]
    copies = table["copies"].to_numpy()[keep]
    across = (table["i"].to_numpy() != table["j"].to_numpy())[keep]
    n = len(keep)
    trie = Trie(block, lens[keep], hashes[_spread(start[keep], lens[keep])])
    labels, links = np.arange(n), np.zeros(n, dtype=np.int64)
    # where two chunks meet, each has met itself elsewhere
    met = np.where(across, chunk.astype(np.int64), -1 - np.arange(n))
    if count_links:
        for a, b in trie.links(num, den, (met,)):
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            labels = least_labels(labels, a, b)
    else:
        # rows of one label in a block are connected, and so are linked neighbours
        _, first, known = np.unique(np.stack([block.astype(np.int64), label]), axis=1, return_index=True, return_inverse=True)
        labels = least_labels(labels, np.arange(n), first[known.ravel()])
        a, b = trie.neighbours(num, den)
        labels = least_labels(labels, a, b)
        for a, b in trie.links(num, den, (labels, met)):
            labels = least_labels(labels, a, b)
    return pa.RecordBatch.from_arrays([_signed(node), _signed(node[labels]), pa.array(links)], names=["node", "label", "links"])


def linked_nodes(blocks: DataFrame, size: int, num: int, den: int, count_links: bool = False) -> DataFrame:
    """Joins blocks that come in the order of root, i, j."""

    def run(batches):
        held, elements, last = [], 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            block = np.stack([table[x].to_numpy() for x in ("root", "i", "j")])
            total = np.concatenate([[0], np.cumsum(table["n_shingles"].to_numpy())])
            head = np.concatenate([[last is not None and (block[:, 0] != last).any()], (block[:, 1:] != block[:, :-1]).any(axis=0)])
            begin = 0
            for r in np.flatnonzero(head).tolist():
                if elements + int(total[r] - total[begin]) >= FOREST_ELEMENTS:
                    if r > begin:
                        held.append(table.slice(begin, r - begin))
                    yield _join_blocks(pa.concat_tables(held), size, num, den, count_links)
                    held, elements, begin = [], 0, r
            held.append(table.slice(begin))
            elements += int(total[-1] - total[begin])
            last = block[:, -1]
        if held:
            yield _join_blocks(pa.concat_tables(held), size, num, den, count_links)

    return blocks.mapInArrow(lean(run), "node long, label long, links long")


def _star_labels(texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """node and root (the least node that it is connected with by stars)."""
    pieces = F.explode(F.sequence(F.lit(0), F.col("own_pieces") - 1)).alias("piece")
    hubs = texts.where("own_pieces is not null").select(F.col("node").alias("hub"), pieces, F.lit(0).alias("place"), "node", "text")
    others = texts.where("hub is not null").select("hub", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("piece"), F.lit(1).alias("place"), "node", "text")
    stars = hubs.unionAll(others).repartition("hub", "piece").sortWithinPartitions("hub", "piece", "place")
    found = star_links(stars, size, num, den)
    return components(found.select(F.col("node").alias("u"), F.col("hub").alias("v")))


def jaccard_components(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text: str = "text", thin: bool = False, count_links: bool = False) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id and chosen (whether the component is named after it) of each document.

    thin: leave popular shingles out of keys, for thresholds that leave few shingles to a part.
    count_links: n_links besides, the number of other documents that it links with.
    """
    least_id = F.lit(-(1 << 63))
    with passing(docs.sparkSession) as keep:
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text"))
        sets = written(set_table(docs, size), "sets", keep)
        keys = key_table(docs, size, num, den, popular_shingles(docs, size, sets.count()) if thin else None)
        # a key comes once from each batch of texts, so a key that very many texts have is few rows
        least = F.first("node").over(Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
        edges = written(keys.withColumn("least", least).where("node <> least").select("node", "least"), "edges")
        roots = components(edges.select(F.col("node").alias("u"), F.col("least").alias("v")))

        named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
        nodes = written(sets.where("n_shingles > 0").groupBy("node").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles")), "nodes")
        members = nodes.join(roots, "node").join(edges.groupBy("node").agg(F.min("least").alias("hub")), "node", "left")
        members = written(members.select("node", "root", "hub", "copies", "n_shingles", F.coalesce("first.doc_id", least_id).alias("id"), F.col("first.text_key").alias("text_key")), "members")
        pieces = members.where("hub is not null").groupBy("hub").agg(F.ceil(F.sum("n_shingles") / STAR_ELEMENTS).cast("int").alias("pieces"))
        with_pieces = members.join(pieces, "hub", "left").join(pieces.select(F.col("hub").alias("node"), F.col("pieces").alias("own_pieces")), "node", "left")
        # members grow with the corpus, so they are never broadcast
        texts = docs.select(F.coalesce("doc_id", least_id).alias("id"), "text_key", "text").join(with_pieces.hint("merge"), ["id", "text_key"])
        texts = written(texts.select("node", "root", "hub", "pieces", "own_pieces", "n_shingles", "text"), "texts")

        stars = None
        if count_links:
            members = members.withColumn("label", F.col("node"))
        else:
            stars = written(_star_labels(texts, size, num, den), "stars")
            members = members.join(stars.select("node", F.col("root").alias("star")), "node", "left").withColumn("label", F.coalesce("star", "node"))
        members = written(members.select("node", "root", "label", "copies", "n_shingles"), "labelled")
        sizes = members.groupBy("root", "label").agg(F.sum("n_shingles").alias("n"))
        sizes = sizes.groupBy("root").agg(F.sum("n").alias("all"), F.max(F.struct("n", F.col("label").alias("main"))).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        apart = F.col("most.n") > CHUNK_ELEMENTS
        sizes = sizes.select(
            "root", F.when(apart, F.col("most.main")).alias("main"),
            F.when(apart, F.ceil(F.col("most.n") / CHUNK_ELEMENTS)).otherwise(0).cast("int").alias("main_chunks"),
            F.ceil((F.col("all") - F.when(apart, F.col("most.n")).otherwise(0)) / CHUNK_ELEMENTS).cast("int").alias("chunks"),
        )
        members = members.join(sizes, "root")
        inside = F.col("label").eqNullSafe(F.col("main"))
        spread = F.xxhash64("node")
        chunk = F.when(inside, F.col("chunks") + F.pmod(spread, F.greatest("main_chunks", F.lit(1)))).otherwise(F.pmod(spread, F.greatest("chunks", F.lit(1)))).cast("int")
        meets = F.when(inside, F.col("chunks")).otherwise(F.col("chunks") + F.col("main_chunks"))
        members = members.select("node", "label", "copies", chunk.alias("chunk"), meets.alias("meets"))
        blocks = texts.select("node", "root", "n_shingles", "text").join(members.hint("merge"), "node")
        blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
        blocks = blocks.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "label", "copies", "n_shingles", "text")
        blocks = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
        found = written(linked_nodes(blocks, size, num, den, count_links), "links")

        tied = found.select(F.col("node").alias("u"), F.col("label").alias("v"))
        if stars is not None:
            tied = tied.unionAll(stars.select(F.col("node").alias("u"), F.col("root").alias("v")))
        final = components(tied)
        state = nodes.join(final, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
        if count_links:
            state = state.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        else:
            state = state.withColumn("links", F.lit(0))
        state = written(state, "state")
        named = state.groupBy("root").agg(F.min("first").alias("chosen"))
        state = state.join(named, "root").select("node", "chosen", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
        state = written(state, "chosen", keep)
    out = sets.join(state, "node", "left")
    return out.select(
        "doc_id", "text_key", "n_shingles",
        F.when(F.col("chosen").isNull(), F.col("doc_id")).otherwise(F.col("chosen.doc_id")).alias("component_id"),
        (F.col("chosen").isNull() | (F.col("chosen.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("chosen.text_key") == F.col("text_key")))).alias("chosen"),
        *([F.coalesce("links", F.lit(0)).alias("n_links")] if count_links else []),
    )


def deduplicate(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays: the one with the least id. Rows without words all stay."""
    state = jaccard_components(docs, size, num, den, id_col, text, thin=True).where("chosen")
    state = state.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("text_key").alias("__key"), (F.col("n_shingles") > 0).alias("__set")).distinct()
    rows = docs.select(row_of(docs), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__key"))
    rows = rows.join(state.hint("merge"), ["__id", "__key"])
    nth = F.row_number().over(Window.partitionBy("__id", "__key").orderBy("__id", "__key"))
    return rows.withColumn("__nth", nth).where("__nth = 1 or not __set").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[][] WHEN len(w) < {SIZE} THEN [w]
      ELSE list_transform(range(1, len(w) - {SIZE - 2}), lambda i: w[i : i + {SIZE - 1}]) END) AS g FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
