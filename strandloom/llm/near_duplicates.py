"""Near-duplicate records with small edits: a binary-trie self-join under a Hamming error budget.

A record is its set of words. Two sets A and B are similar to the degree t (shared words over words in either) exactly where
they differ in at most (1 - t) / (1 + t) * (|A| + |B|) words: a Hamming budget on their indicator vectors. Folding the indicator
vector to 256 bits by parity can only lower the distance, so a trie over the folded bits, traversed in node pairs that
accumulate differing bits and are dropped beyond the budget, loses no pair. Which records meet in a trie is decided by prefix
tokens: two similar sets share one of their rarest |A| - ceil(t |A|) + 1 words, under any total order of the words. Words are
numbered by their exact frequency; one that occurs in a single row is shared with nothing and takes part by its number only.
The trie's strides are 16 bits: the error budget is checked after each of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.session import cut_lineage, stored

THRESHOLD, MIN_WORDS = 0.65, 10
#: Words of 16 bits in a folded signature, sets in a block half.
STRIDES, BLOCK = 16, 20_000
#: Most words that are broadcast with their numbers (16 bytes each); beyond, numbers are joined by a shuffle.
BROADCAST_WORDS = 2_000_000
_PAIRS_AT_ONCE, _ROWS_AT_ONCE = 2_000_000, 200_000
_ENTRY = "block long, part int, sid long, n int, sig binary"
_SET = "key binary, n int, ids array<bigint>, sig binary"


def words_of(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 in the lower-cased text; null gives none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def report_text(last_error: Column, records: Column) -> Column:
    """last_error and all error_signature and root_cause of the memory records as one text."""
    told = F.transform(F.coalesce(records, F.array().cast(_RECORDS)), lambda r: F.concat_ws(" ", r["error_signature"], r["root_cause"]))
    return F.concat_ws(" ", last_error, F.array_join(told, " "))


_RECORDS = "array<struct<iteration:int,phase:string,outcome:string,error_signature:string,root_cause:string,fix_strategy:string,context_terms:array<string>>>"


def fold_signatures(tokens: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, STRIDES) 16-bit words: parity of the tokens' bits per row."""
    bits = 16 * STRIDES
    at = ((tokens.astype(np.uint64) >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)
    parity = (np.bincount(rows * bits + at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(parity, axis=1).view(">u2").astype(np.uint16)


def trie_self_join(group: np.ndarray, sig: np.ndarray, size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (a, b) of equal group whose folded distance is within the budget of their sizes.

    A trie holds the groups on its first level and 16 bits of the signature on each further one. Pairs of nodes go down
    together; a pair carries the bits that differ so far and is dropped once they exceed the budget of the largest sets below.
    Pairs are worked off depth first in portions, so that memory doesn't follow their number.
    """
    ratio = (1 - Fraction(str(t))) / (1 + Fraction(str(t)))
    num, den = ratio.numerator, ratio.denominator
    order = np.lexsort((*sig.T[::-1], group))
    group, sig, size = group[order], sig[order], size[order].astype(np.int64)
    m = len(group)
    new = np.ones(m, bool)
    new[1:] = group[1:] != group[:-1]
    starts, labels = [np.flatnonzero(new)], [np.zeros(0)]
    for level in range(sig.shape[1]):
        new[1:] |= sig[1:, level] != sig[:-1, level]
        starts.append(np.flatnonzero(new))
        labels.append(sig[starts[-1], level])
    starts.append(np.arange(m))  # the rows themselves
    depth = len(starts) - 1
    ends = [np.append(s[1:], m) for s in starts]
    most = [np.maximum.reduceat(size, s) if m else size for s in starts]
    down = [(np.searchsorted(starts[k + 1], starts[k]), np.searchsorted(starts[k + 1], ends[k])) for k in range(depth)]
    roots = np.flatnonzero(ends[0] - starts[0] > 1)
    stack = [(0, roots, roots, np.zeros(len(roots), np.int64))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while stack:
        level, a, b, far = stack.pop()
        if not len(a):
            continue
        lo, hi = down[level]
        na, nb = hi[a] - lo[a], hi[b] - lo[b]
        total = np.cumsum(na * nb)
        if len(a) > 1 and total[-1] > _PAIRS_AT_ONCE:
            cut = max(1, int(np.searchsorted(total, _PAIRS_AT_ONCE)))
            stack += [(level, a[cut:], b[cut:], far[cut:]), (level, a[:cut], b[:cut], far[:cut])]
            continue
        if total[-1] > 4 * _PAIRS_AT_ONCE and na[0] > 1:  # one wide pair: child by child of its first node
            for x in range(lo[a[0]], hi[a[0]]):
                y = np.arange(max(lo[b[0]], x) if a[0] == b[0] else lo[b[0]], hi[b[0]])
                stack += _kept(level + 1, np.full(len(y), x), y, np.full(len(y), far[0]), labels, most, starts, ends, depth, num, den, found)
            continue
        pair = np.repeat(np.arange(len(a)), na * nb)
        inner = np.arange(total[-1]) - np.repeat(total - na * nb, na * nb)
        x, y = lo[a[pair]] + inner // nb[pair], lo[b[pair]] + inner % nb[pair]
        keep = (a[pair] != b[pair]) | (x <= y)
        stack += _kept(level + 1, x[keep], y[keep], far[pair[keep]], labels, most, starts, ends, depth, num, den, found)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate([x for x, _ in found])], order[np.concatenate([y for _, y in found])]


def _kept(level, x, y, far, labels, most, starts, ends, depth, num, den, found):
    """Drop the pairs over budget; at the rows, note the pairs, else return what is to be gone through."""
    if level < depth:
        far = far + np.bitwise_count(labels[level][x] ^ labels[level][y])
    keep = (far * den <= num * (most[level][x] + most[level][y])) & ((x != y) | (ends[level][x] - starts[level][x] > 1))
    x, y, far = x[keep], y[keep], far[keep]
    if level < depth:
        return [(level, x, y, far)]
    found.append((x, y))
    return []


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a list column and their row numbers."""
    lengths = np.asarray(column.value_lengths())
    return np.asarray(column.flatten()).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)


def word_numbers(words: DataFrame) -> DataFrame:
    """(token, number) of the tokens in at least two rows of ``words`` (tokens array), rarest first; equally frequent ones by hash."""
    counts = words.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = counts.repartitionByRange("n", "token").sortWithinPartitions("n", "token")
    return stored(ordered.select("token", F.monotonically_increasing_id().alias("number")))


def encoded(rows: DataFrame, numbers: DataFrame, limit: int = BROADCAST_WORDS) -> DataFrame:
    """_SET rows of (key, tokens): size, sorted numbers of the shared tokens and folded signature of all tokens.

    The numbers go to every task where there are at most ``limit``; beyond, tokens are joined with them, a row for each key.
    """

    def pack(batches: Iterable[pa.RecordBatch], held=None) -> Iterator[pa.RecordBatch]:
        known, number = held.value if held is not None else (None, None)
        for batch in batches:
            tokens, row = _flat(batch.column(1))
            n = np.bincount(row, minlength=batch.num_rows)
            if held is None:
                ids = np.asarray(batch.column(2).flatten().fill_null(-1))
            else:
                at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
                ids = np.where(known[at] == tokens, number[at], -1) if len(known) else np.full(len(tokens), -1)
            shared = np.flatnonzero(ids >= 0)
            shared = shared[np.lexsort((ids[shared], row[shared]))]
            ends = np.r_[0, np.cumsum(np.bincount(row[shared], minlength=batch.num_rows))]
            sig = pa.array([s.tobytes() for s in fold_signatures(tokens, row, batch.num_rows)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[shared], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), lists, sig], names=["key", "n", "ids", "sig"])

    if numbers.limit(limit + 1).count() > limit:
        once = rows.groupBy("key").agg(F.first("tokens").alias("tokens")).select("key", F.explode("tokens").alias("token"))
        joined = once.join(numbers.hint("merge"), "token", "left").groupBy("key").agg(F.collect_list(F.struct("token", "number")).alias("t"))
        return joined.select("key", F.col("t.token").alias("tokens"), F.col("t.number").alias("numbers")).mapInArrow(pack, _SET)
    table = numbers.orderBy("token").toArrow()
    held = rows.sparkSession.sparkContext.broadcast((np.asarray(table.column("token")), np.asarray(table.column("number"))))
    return rows.select("key", "tokens").mapInArrow(lambda batches: pack(batches, held), _SET)


def prefix_tokens(n: Column, ids: Column, threshold: float) -> Column:
    """The shared ones among a set's first n - ceil(t n) + 1 tokens; those that are shared with nothing come before them."""
    t = Fraction(str(threshold))
    most = n - F.ceil(n * t.numerator / F.lit(t.denominator) - 1e-9) + 1 - (n - F.size(ids))
    return F.slice(ids, 1, F.greatest(most, F.lit(0)).cast("int"))


def candidate_pairs(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, numbers of sets (sid, n, ids, sig) within the folded budget: no similar pair is missing.

    Sets meet in the blocks of their prefix tokens. A token that more than ``block`` sets hold in their prefix is split: its sets
    fall into k parts, and each pair of parts is a block of its own. Tokens in one set's prefix only make no block.
    """
    met = sets.select("sid", "n", "sig", F.explode(prefix_tokens(F.col("n"), F.col("ids"), threshold)).alias("block"))
    counts = met.groupBy("block").agg(F.count("*").alias("m"))
    large = counts.filter(F.col("m") > block).select("block", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    large = stored(large)  # no more rows than all entries over ``block``
    hinted = F.broadcast(large) if large.count() <= BROADCAST_WORDS else large
    own = F.pmod(F.xxhash64("sid", "block"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other")
    spread = met.join(hinted, "block", "left").select("block", F.coalesce(own, F.lit(0)).alias("own"), "parts", "sid", "n", "sig", other)
    part = F.least("own", "other") * F.coalesce("parts", F.lit(1)) + F.greatest("own", "other")
    entries = spread.select("block", part.cast("int").alias("part"), "sid", "n", "sig")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(rows: pa.Table) -> pa.RecordBatch:
            cols = [np.asarray(rows.column(c)) for c in ("block", "part")]
            change = np.ones(rows.num_rows, bool)
            change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            group = np.cumsum(change) - 1
            many = np.bincount(group)[group] > 1
            at = np.flatnonzero(many)
            raw = b"".join(rows.column("sig").take(pa.array(at)).to_pylist())
            sig = np.frombuffer(raw, np.uint16).reshape(len(at), STRIDES)
            a, b = trie_self_join(group[at], sig, np.asarray(rows.column("n"))[at], threshold)
            sid = np.asarray(rows.column("sid"))
            x, y = sid[at[a]], sid[at[b]]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _ROWS_AT_ONCE:
                rows = pa.Table.from_batches(held).combine_chunks()
                last = [rows.column(c)[-1] for c in ("block", "part")]
                tail = np.logical_and.reduce([np.asarray(rows.column(c)) == v.as_py() for c, v in zip(("block", "part"), last)])
                cut = int(np.argmax(tail))  # the last block may go on in the next batch
                if cut:
                    yield work(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    ordered = entries.repartition("block", "part").sortWithinPartitions("block", "part")
    return ordered.mapInArrow(join, "a long, b long").distinct()


def word_sets(records: DataFrame, min_words: int, limit: int = BROADCAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """members (id, sid) and sets (sid, n, ids, sig) of records (id, words) with at least ``min_words`` distinct words.

    Texts are read once; their words, and then the encoded sets, are kept as tables.
    """
    rows = records.filter(F.col("id").isNotNull() & (F.size("words") >= min_words))
    rows = stored(rows.select("id", F.sort_array("words").alias("words")).select("id", F.unhex(F.md5(F.array_join("words", " "))).alias("key"), "words"))
    hashed = rows.select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("tokens"))
    coded = encoded(hashed, word_numbers(hashed), limit)
    once = coded.groupBy("key").agg(F.first("n").alias("n"), F.first("ids").alias("ids"), F.first("sig").alias("sig"))
    sets = stored(once.withColumn("sid", F.monotonically_increasing_id()))
    members = rows.select("id", "key").distinct().join(sets.select("key", "sid"), "key").select("id", "sid")
    return stored(members), sets.select("sid", "n", "ids", "sig")


def similar_sets(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of the candidate pairs that hold against the sets themselves."""
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("ids").alias(f"i{x}"))
    pairs = candidate_pairs(sets, threshold, block).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.select("a", "b", F.size(F.array_intersect("ia", "ib")).alias("both"), (F.col("na") + F.col("nb")).alias("all"))
    likeness = F.col("both") / (F.col("all") - F.col("both"))
    t = Fraction(str(threshold))
    return pairs.filter(F.col("both") * t.denominator >= (F.col("all") - F.col("both")) * t.numerator).select("a", "b", likeness.alias("similarity"))


def near_duplicate_pairs(records: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, block: int = BLOCK, limit: int = BROADCAST_WORDS) -> DataFrame:
    """(id_a, id_b), a < b: all pairs of records (id, words array) whose word sets are similar to at least ``threshold``.

    Records with a null id, null words or fewer than ``min_words`` distinct words are in no pair; repeated rows count once; an
    id with several different word sets pairs by each of them, never with itself. Order and repetition of words don't matter.
    """
    members, sets = word_sets(records, min_words, limit)
    links = similar_sets(sets, threshold, block).select("a", "b")
    copied = members.groupBy("sid").agg(F.count("*").alias("m")).filter("m > 1")
    links = links.unionByName(copied.select(F.col("sid").alias("a"), F.col("sid").alias("b")))
    pairs = links.join(members.select(F.col("id").alias("x"), F.col("sid").alias("a")), "a").join(members.select(F.col("id").alias("y"), F.col("sid").alias("b")), "b")
    pairs = pairs.filter("(a = b AND x < y) OR (a <> b AND x <> y)")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, root): the least key reachable from each node over edges (a, b); labels halve their way by pointer jumps."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(nodes.select("key", F.col("key").alias("root")))
    while True:
        offers = both.join(label.select(F.col("key").alias("b"), "root"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("offer"))
        near = label.join(offers, "key", "left").select("key", F.col("root").alias("was"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        jump = near.select(F.col("key").alias("root"), F.col("root").alias("further"))
        nxt = cut_lineage(near.join(jump, "root").select("key", "was", F.least("root", "further").alias("root")))
        if nxt.filter("was <> root").isEmpty():
            return nxt.select("key", "root")
        label = nxt.select("key", "root")


def near_duplicate_groups(records: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per record: id, class_id (least id of the records with the same words), group_id (least id of the connected
    group), n_links (records linked to it, copies included). Copies are not expanded into pairs. Cases as in the pairs."""
    members, sets = word_sets(records, min_words)
    links = cut_lineage(similar_sets(sets, threshold).select("a", "b"))
    own = members.groupBy(F.col("sid").alias("key")).agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    sizes = own.select(F.col("key").alias("b"), "n")
    linked = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(sizes, "b").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    root = components(links, sets.select(F.col("sid").alias("key"))).join(own, "key")
    group = root.groupBy("root").agg(F.min("class_id").alias("group_id"))
    classes = root.join(group, "root").join(linked, "key", "left")
    classes = classes.select(F.col("key").alias("sid"), "class_id", "group_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return members.join(classes, "sid").select("id", "class_id", "group_id", "n_links")


def experience_words(experience: DataFrame) -> DataFrame:
    """(id, words) of the experience rows."""
    return experience.select(F.col("exp_id").alias("id"), words_of(report_text(F.col("last_error"), F.col("memory_records"))).alias("words"))
