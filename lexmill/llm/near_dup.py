"""Records that are the same but for small edits: a similarity join by the generalised pigeonhole principle."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import shuffles_freed
from .common import WORD, Scratch, WordIds, mix, sets_of, triple_hashes, verified_pairs, written

#: Symbols of a signature, symbols in which similar texts agree at least, probes that then meet at least, different
#: words a text must have. Texts of similarity 0.5 agree in 24 of 48 symbols on average, with a deviation of 3.5:
#: fewer than 10 have a chance of 1 in 130,000, and less than 1 in 10^6 from a similarity of 0.55.
SYMBOLS, LEAST_EQUAL, LEAST_HITS, LEAST_WORDS = 48, 10, 1, 20
#: Cells of the sketch of candidate counts: as many for each million records, from 1 to 16 times (at most 64 MB).
CELLS, MOST_CELLS = 1 << 20, 1 << 24
#: Gains whose cost tells whether a record's symbols are shared alike, and candidates beyond the sketch's noise that its probes may bring;
#: records of more are joined on their rarest triples instead, see ``allocated`` and ``rare_pairs``.
LEAST_GAINS, BUDGET = 24, 3_000
#: Records of one key from which on they are spread over several join keys.
SPREAD = 10_000
#: Keys that one pass shuffles, with their records' signatures; passes follow each other, so only one's files are on disk. Pairs compared at a time.
PASS_KEYS, BLOCK = 1 << 21, 1 << 18
#: Copies of one text up to which all their pairs are written; beyond, each copy is paired with the class's first id only.
ALL_PAIRS = 64


def signatures(docs: DataFrame) -> DataFrame:
    """(id, class, words, signature) of each row of (id, text), row by row.

    class: hash of the sequence of words, equal for texts that differ only in case and punctuation. signature:
    for each of 48 hash functions the least hash over all runs of three words. Rows whose text is null or has
    fewer than 20 different words are left out: they are similar to nothing.
    """
    return docs.select("id", "text").where("id is not null").mapInArrow(_signatures, "id long, class string, words int, signature array<int>")


def _signatures(batches):
    import pyarrow as pa
    import xxhash

    ids = WordIds()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            keys, classes, counts, words, starts = [], [], [], [], [0]
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = WORD.findall((text or "").lower())
                n = len(set(found))
                if n < LEAST_WORDS:
                    continue
                keys.append(key)
                classes.append(xxhash.xxh3_128_hexdigest(" ".join(found).encode("utf-8", "surrogatepass")))
                counts.append(n)
                words += [ids[w] for w in found]
                starts.append(len(words))
            if not keys:
                continue
            h, doc = triple_hashes(np.array(words, np.uint64), np.array(starts))
            sig = _symbols(h, np.searchsorted(doc, np.arange(len(keys))))
            values = pa.array(sig.ravel().view(np.int32))
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * SYMBOLS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(classes), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(offsets, values)],
                ["id", "class", "words", "signature"],
            )


def _symbols(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The signatures of sets of 64-bit hashes, of which each begins at ``first``."""
    factor = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
    sig = np.empty((len(first), SYMBOLS), np.uint32)
    for k in range(SYMBOLS):
        x = h * factor[k]
        sig[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), first) >> np.uint64(32)
    return sig


def partition_keys(sig: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each signature and partition: of the two symbols together, of the first and of the second alone.

    ``sig`` may hold some partitions' symbols only; ``first`` is then the number of the first of them.
    """
    s = sig.view(np.uint32).astype(np.uint64) if sig.dtype == np.int32 else sig.astype(np.uint64)
    a, b = s[:, 0::2], s[:, 1::2]
    part = (np.arange(first, first + a.shape[1], dtype=np.uint64) + np.uint64(1)) << np.uint64(3)
    return mix(mix(a + (part << np.uint64(33))) + b + part), mix((a << np.uint64(20)) + part + np.uint64(1)), mix((b << np.uint64(20)) + part + np.uint64(2))


def _table(both: np.ndarray, one: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the least cost of exactly k gains (of ``need`` or more, for the last k), and the steps that lead there."""
    n, m = both.shape
    best = np.full((n, need + 1), np.inf)
    best[:, 0] = 0
    steps = np.zeros((m, n, need + 1), np.int8)
    for i in range(m):
        now = best.copy()
        for gain, cost in ((1, both[:, i]), (2, one[:, i])):
            for short in range(gain):  # the last step may gain more than is missing
                target, source = need, need - gain + short
                if short and source >= 0:
                    c = best[:, source] + cost
                    better = c < now[:, target]
                    now[better, target] = c[better]
                    steps[i, better, target] = gain * 10 + short
            c = best[:, : need + 1 - gain] + cost[:, None]
            better = c < now[:, gain:]
            now[:, gain:][better] = c[better]
            steps[i, :, gain:][better] = gain * 10
        best = now
    return best, steps


def _thresholds(steps: np.ndarray, gains: np.ndarray) -> np.ndarray:
    m, n = steps.shape[:2]
    e, left, rows = np.full((n, m), -1, np.int8), gains.copy(), np.arange(n)
    for i in range(m - 1, -1, -1):
        code = steps[i, rows, left]
        e[:, i] = code // 10 - 1
        left = left - code // 10 + code % 10
    return e


def allocate(both: np.ndarray, one: np.ndarray, need: int) -> np.ndarray:
    """Thresholds of least estimated cost, by dynamic programming, for each row.

    A signature that differs from this one in at most t symbols differs, in some partition i, in at most e_i, if
    the sum of (e_i + 1) exceeds t (``need`` = t + 1). e_i = -1 leaves partition i out and costs nothing; 0 probes
    for both symbols, at the cost ``both``; 1 probes for either, at the cost ``one``. Both are (rows, partitions).
    """
    return _thresholds(_table(both, one, need)[1], np.full(len(both), need))


def allocated(both: np.ndarray, one: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and gains of each row: all ``need`` gains, unless the last of them cost far more than the first.

    The same table of the dynamic programme has the cost of every smaller number of gains. A row takes the most gains that cost up to
    BUDGET, or up to three times what LEAST_GAINS cost. So a record has fewer gains where a great part of all records shares some of its
    symbols while its others are rare (a site's template), and all of them where all are shared alike (copies with small edits, which must
    all meet). With fewer gains a pair could be lost: such records don't probe, they are found by the others' probes and, among
    themselves, by ``rare_pairs``.
    """
    best, steps = _table(both, one, need)
    k = np.arange(need + 1)
    fits = (best <= np.maximum(BUDGET, 3 * best[:, LEAST_GAINS : LEAST_GAINS + 1])) & (k >= LEAST_GAINS)
    gains = np.where(fits, k, 0).max(1)
    return _thresholds(steps, gains), gains


def _signature_rows(column) -> np.ndarray:
    return np.ascontiguousarray(np.array(column.flatten()).reshape(-1, SYMBOLS))


def _bits(records: int) -> int:
    return int(np.clip(np.ceil(np.log2(CELLS * max(1.0, records / 1_000_000))), np.log2(CELLS), np.log2(MOST_CELLS)))


def _counted(column: DataFrame, bits: int, cells_of) -> np.ndarray:
    """How often ``cells_of`` gives each of 2^bits cells for the one column of a table; only these numbers reach the driver."""

    def run(batches):
        import pyarrow as pa

        cells = np.zeros(1 << bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                for at in cells_of(batch.column(0)):
                    cells += np.bincount(at.ravel(), minlength=1 << bits)
        used = np.flatnonzero(cells)
        for lo in range(0, len(used), 100_000):
            at = used[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])

    found = column.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(1 << bits, np.int64)
    cells[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return cells.astype(np.int32) if cells.max(initial=0) < 2**31 else cells


def count_cells(sigs: DataFrame, records: int | None = None) -> np.ndarray:
    """How many keys of all records fall into each cell of a sketch, whose size follows the number of records; at most MOST_CELLS numbers reach the driver."""
    bits = _bits(sigs.count() if records is None else records)

    def cells_of(column):
        return ((keys >> np.uint64(64 - bits)).astype(np.int64) for keys in partition_keys(_signature_rows(column)))

    return _counted(sigs.select("signature"), bits, cells_of)


def probes(sig: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, whether each is probed, records that share its cell, gains of each row) of signatures. Costs are counted beyond the mean of
    all cells, which is the noise of unrelated keys."""
    keys = partition_keys(np.ascontiguousarray(sig))
    bits = int(np.log2(len(cells)))
    n = [cells[(k >> np.uint64(64 - bits)).astype(np.int64)].astype(np.float64) for k in keys]
    noise = float(cells.mean())
    cost = [np.maximum(0.0, x - 1 - noise) + 1e-3 * x for x in n]
    e, gains = allocated(cost[0], cost[1] + cost[2], SYMBOLS - LEAST_EQUAL + LEAST_HITS)
    return np.concatenate(keys, axis=1), np.concatenate([e == 0, e == 1, e == 1], axis=1), np.concatenate(n, axis=1), gains


#: One row for each key of a record: its role (0: may be met, 1: may be met and asks, 2: asks only) and one byte of each symbol.
_BYTES = [f"s{k}" for k in range(SYMBOLS // 8)]
_KEYS = "key long, id long, role byte, " + ", ".join(f"{x} long" for x in _BYTES)


def _bytes(sig: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(sig.astype(np.uint8)).view(np.int64)


def _key_rows(ids: np.ndarray, short: np.ndarray, at: np.ndarray, key: np.ndarray, own: np.ndarray, asks: np.ndarray, n: np.ndarray):
    """Rows of ``_KEYS`` for the keys of the records ``at`` of (ids, short), of which ``own`` may be met and ``asks`` meet others.

    n is at least the number of records of the same key. A key of one record is left out. Keys of very many records are spread: each record has
    one of several join keys by its id, and who asks does so for all of them, so no task gets one key's records whole.
    """
    import pyarrow as pa

    some = np.flatnonzero((own | asks) & (n > 1))
    at, key, own, asks, ways = at[some], key[some], own[some], asks[some], (n[some] / SPREAD).astype(np.int64) + 1
    wide = ways > 1
    plain, more = np.flatnonzero(own | ~wide), np.flatnonzero(asks & wide)
    w = wide[plain]
    met = np.where(w, mix(key[plain] + mix(ids[at[plain]].astype(np.uint64)) % ways[plain].astype(np.uint64)), key[plain])
    role = np.where(own[plain], (asks[plain] & ~w).astype(np.int8), 2)
    times = ways[more]
    each = np.repeat(more, times)
    step = (np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    rows = np.concatenate([at[plain], at[each]])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([met, mix(key[each] + step)]).view(np.int64)), pa.array(ids[rows]), pa.array(np.concatenate([role, np.full(len(each), 2)]).astype(np.int8)),
            *(pa.array(np.ascontiguousarray(short[rows, k])) for k in range(short.shape[1])),
        ],
        ["key", "id", "role", *_BYTES],
    )


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of their bytes rows of int64 agree (at most 255)."""
    equal = (a.view(np.uint8) == b.view(np.uint8)).view(np.uint64).sum(1)
    return (equal * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _meet(batches):
    """(a < b) of the records that share a key one of them asks for and agree in LEAST_EQUAL bytes of their symbols, from rows of ``_KEYS`` by key and role.

    Of a key only the rows that may be met are kept from batch to batch.
    """
    import pyarrow as pa

    key, ids, role, short = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8), np.empty((0, SYMBOLS // 8), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        old = len(key)
        column = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        key, ids, role = (np.concatenate(x) for x in ((key, column[0]), (ids, column[1]), (role, column[2])))
        short = np.concatenate([short, np.stack(column[3:], axis=1)])
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        own = np.add.reduceat((role <= 1).astype(np.int64), start)
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        asking = old + np.flatnonzero(role[old:] >= 1)
        begin = start[group[asking]]
        times = np.minimum(asking - begin, own[group[asking]])  # of two that ask, the later one meets the earlier one
        ends = np.cumsum(times)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, BLOCK):
            x = np.arange(lo, min(lo + BLOCK, int(ends[-1])))
            which = np.searchsorted(ends, x, "right")
            p, q = asking[which], begin[which] + x - (ends[which] - times[which])
            good = (_agreeing(short[p], short[q]) >= LEAST_EQUAL) & (ids[p] != ids[q])
            p, q = ids[p[good]], ids[q[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])
        kept = start[-1] + np.flatnonzero(role[start[-1] :] <= 1)
        key, ids, role, short = key[kept], ids[kept], role[kept], short[kept]


def _met(table: DataFrame, passes: list, rows_of, hold: Scratch) -> DataFrame:
    """Pairs (a < b) that meet in the rows of ``_KEYS`` which ``rows_of(pass)`` makes of ``table``; may repeat across passes."""
    found = []
    for x in passes:
        rows = table.mapInArrow(rows_of(x), _KEYS).repartition("key").sortWithinPartitions("key", "role")
        found.append(hold(rows.mapInArrow(_meet, "a long, b long").distinct(), "met"))
    return reduce(DataFrame.union, found)


def candidate_pairs(sigs: DataFrame, texts: DataFrame, threshold: float, hold: Scratch) -> DataFrame:
    """Pairs (a < b) of ids of (id, signature) that agree in LEAST_EQUAL symbols, one byte of each compared; complete for the similar ones of those.

    The Hamming space has 48 dimensions: the bits of one symbol change together, so a symbol is one dimension and a
    partition never splits it. A partition holds two symbols. How many records share a key is counted over all records in a sketch;
    on these counts each record allocates its own thresholds, so a symbol that very many records share (page furniture, stock phrases) is
    left out or probed only together with its neighbour, and others take its place. A pair within the distance is found from either side, so
    one side's probes suffice. With thresholds whose (e_i + 1) sum to 39, records that agree in A symbols meet in at least A - 9 of the
    keys that one of them probes. Records whose share of common symbols makes that too dear don't probe; ``rare_pairs`` has the pairs of two such.

    Keys carry their records' symbols, so a pair is judged where it meets, and what merely shares a phrase is never written. The partitions are
    worked off in passes.
    """
    spark, records, need = sigs.sparkSession, sigs.count(), SYMBOLS - LEAST_EQUAL + LEAST_HITS
    shared = spark.sparkContext.broadcast(count_cells(sigs, records))

    def plan(batches):
        import pyarrow as pa

        place = np.arange(0, SYMBOLS, 2, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                _, probed, _, gains = probes(_signature_rows(part.column(1)), shared.value)
                e = probed[:, : SYMBOLS // 2] + 2 * probed[:, SYMBOLS // 2 : SYMBOLS]  # two bits for each partition
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((e.astype(np.int64) << place).sum(1)), pa.array(gains < need)], ["id", "signature", "probes", "rest"])

    planned = hold(sigs.select("id", "signature").mapInArrow(plan, "id long, signature array<int>, probes long, rest boolean"), "planned")

    def rows_of(partitions):
        first, last = int(partitions[0]), int(partitions[-1]) + 1

        def run(batches):
            bits = int(np.log2(len(shared.value)))
            place = 2 * np.arange(first, last)
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    sig = _signature_rows(part.column(1))
                    keys = np.concatenate(partition_keys(np.ascontiguousarray(sig[:, 2 * first : 2 * last]), first), axis=1)
                    e = np.where(part.column(3).to_numpy(zero_copy_only=False).astype(bool), 0, part.column(2).to_numpy())[:, None] >> place & 3
                    asks = np.concatenate([e == 1, e == 2, e == 2], axis=1)
                    n = shared.value[(keys >> np.uint64(64 - bits)).astype(np.int64)]
                    at = np.repeat(np.arange(len(sig)), keys.shape[1])
                    yield _key_rows(part.column(0).to_numpy(), _bytes(sig), at, keys.ravel(), np.ones(keys.size, bool), asks.ravel(), n.ravel())

        return run

    passes = np.array_split(np.arange(SYMBOLS // 2), np.clip(-(-records * SYMBOLS * 3 // 2 // PASS_KEYS), 1, SYMBOLS // 2))
    met = _met(planned, passes, rows_of, hold)
    rest = hold(planned.where("rest").select("id"), "rest")
    if rest.limit(2).count() == 2:
        met = met.union(rare_pairs(rest, texts, threshold, hold))
    return met.distinct()


def rare_pairs(ids: DataFrame, texts: DataFrame, threshold: float, hold: Scratch) -> DataFrame:
    """Pairs (a < b) of ``ids`` (id) of ``texts``, complete for those of ``threshold`` that agree in LEAST_EQUAL symbols: a join on the rarest triples.

    With all sets in one order of triples, the rarest first by a sketch, two similar sets share a triple of the larger one's first n - ceil(t n) + 1 and
    of the smaller one's first n - ceil(2 t n / (1 + t)) + 1 (prefix filtering), whatever the order and the sketch. For t = 0.5 every record asks for the first
    half of its triples and may be met in the first third, so what a template of up to two thirds of a text holds brings no pair.
    """
    spark = ids.sparkSession
    sets = hold(sets_of(ids, texts), "rare-sets")
    records = sets.count()
    bits = _bits(records)

    def cells_of(column):
        return [np.array(column.flatten()).view(np.uint32).astype(np.int64) >> (32 - bits)]

    shared = spark.sparkContext.broadcast(_counted(sets.select("triples"), bits, cells_of))

    def order(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                part = part.filter(pc.greater(pc.list_value_length(part.column(1)), 0))
                if not part.num_rows:
                    continue
                value = np.array(part.column(1).flatten()).view(np.uint32)
                first = np.concatenate([[0], np.cumsum(np.diff(np.array(part.column(1).offsets)))])
                n, first = np.diff(first), first[:-1]
                row = np.repeat(np.arange(len(n)), n)
                value = value[np.lexsort((value, shared.value[value.astype(np.int64) >> (32 - bits)], row))]
                asked, own = ((n - np.ceil(share * n - 1e-9)).astype(np.int64) + 1 for share in (threshold, 2 * threshold / (1 + threshold)))
                inside = np.arange(len(value)) - first[row] < asked[row]
                short = _bytes(_symbols(mix(value.astype(np.uint64)), first))  # of the order no trace is left: the least hash is the same
                offsets = np.concatenate([[0], np.cumsum(np.minimum(asked, n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[inside].view(np.int32))), *(pa.array(np.ascontiguousarray(short[:, k])) for k in range(short.shape[1]))],
                    ["id", "own", "triples", *_BYTES],
                )

    rare = hold(sets.mapInArrow(order, "id long, own int, triples array<int>, " + ", ".join(f"{x} long" for x in _BYTES)), "rare")
    keys = rare.agg(F.sum(F.size("triples"))).first()[0] or 0
    many = max(1, -(-keys // PASS_KEYS))

    def rows_of(number):
        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    value = np.array(part.column(2).flatten()).view(np.uint32).astype(np.uint64)
                    n = np.diff(np.array(part.column(2).offsets))
                    at = np.repeat(np.arange(len(n)), n)
                    own = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n) < part.column(1).to_numpy()[at]
                    key = mix(value + np.uint64(1))
                    mine = np.flatnonzero(key % np.uint64(many) == np.uint64(number))
                    count = shared.value[value[mine].astype(np.int64) >> (32 - bits)]
                    short = np.stack([part.column(3 + k).to_numpy() for k in range(len(_BYTES))], axis=1)
                    yield _key_rows(part.column(0).to_numpy(), short, at[mine], key[mine], own[mine], np.ones(len(mine), bool), count)

        return run

    return _met(rare, list(range(many)), rows_of, hold)


def similar_classes(docs: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The members (id, class_id) of all texts of 20 or more different words, and the links (a, b, similarity)
    between classes of different texts.

    ``docs`` has id and text. Copies (equal sequences of words) are one class, named by its least id, and are compared
    once. A repeated row counts once; of rows with one id and different texts the one with the least class hash counts.
    """
    with shuffles_freed(docs.sparkSession):
        return _similar_classes(docs, threshold)


def _similar_classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    early, hold, work = Scratch(), Scratch(), Scratch()
    sigs = early(signatures(docs), "signatures")
    one = sigs.groupBy("id").agg(F.min("class").alias("class"))
    first = one.groupBy("class").agg(F.min("id").alias("class_id"))
    members = written(one.join(first, "class").select("id", "class_id", "class"), "members")
    heads = members.where("id = class_id").select("id", "class")
    head_sigs = hold(sigs.join(heads, ["id", "class"], "left_semi").select("id", "signature").dropDuplicates(["id"]), "heads")
    early.discard()
    texts = docs.select("id", "text")
    pairs = work(candidate_pairs(head_sigs, texts, threshold, hold), "candidates")
    hold.discard()
    links = written(verified_pairs(pairs, texts, threshold, work), "links")
    work.discard()
    return members.select("id", "class_id"), links


def similar_pairs(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id_a < id_b) of all similar records of ``docs`` (id, text).

    Links between classes are written out for their copies. In a class of more than 64 copies, each copy is
    paired with the class's first id, and such a class meets linked classes through its first id; the members of
    ``similar_classes`` tell the rest. Null ids and texts give no pairs.
    """
    members, links = similar_classes(docs, threshold)
    size = members.groupBy("class_id").agg(F.count("*").alias("n"))
    spread = members.join(size, "class_id").where((F.col("n") <= ALL_PAIRS) | (F.col("id") == F.col("class_id"))).select("class_id", "id")
    across = (
        links.join(spread.select(F.col("class_id").alias("a"), F.col("id").alias("ia")), "a")
        .join(spread.select(F.col("class_id").alias("b"), F.col("id").alias("ib")), "b").select("ia", "ib")
    )
    several = size.where("n > 1")
    few = spread.join(several.where(F.col("n") <= ALL_PAIRS), "class_id").select("class_id", "id")
    within = few.select("class_id", F.col("id").alias("ia")).join(few.select("class_id", F.col("id").alias("ib")), "class_id").where("ia < ib").select("ia", "ib")
    star = members.join(several.where(F.col("n") > ALL_PAIRS), "class_id").where("id != class_id").select(F.col("class_id").alias("ia"), F.col("id").alias("ib"))
    return across.union(within).union(star).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def similar_groups(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, class_id, group_id, n_links) of each record of 20 or more different words: copies share class_id, records joined by links
    share group_id, the least id of the group; n_links counts the other classes the record's class is linked with.

    Groups are found by passing the least id along links and then jumping to that id's own least id, until nothing
    changes; each round is written to the shared folder.
    """
    with shuffles_freed(docs.sparkSession):
        return _similar_groups(docs, threshold)


def _similar_groups(docs: DataFrame, threshold: float) -> DataFrame:
    members, links = similar_classes(docs, threshold)
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    hold = Scratch()
    label = hold(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("g")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "g"), "b").groupBy(F.col("a").alias("id")).agg(F.min("g").alias("near"))
        step = label.join(near, "id").select("id", F.least("g", "near").alias("new"), F.col("g").alias("old"))
        far = label.select(F.col("id").alias("new"), F.col("g").alias("jump"))
        step = hold(step.join(far, "new", "left").select("id", F.least("new", F.coalesce("jump", "new")).alias("g"), "old"), "labels")
        changed = step.where("g != old").limit(1).count()
        label = step.select("id", "g")
        if not changed:
            break
    label = written(label, "groups")
    hold.discard()
    n = both.groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("n_links"))
    return (
        members.join(label.select(F.col("id").alias("class_id"), "g"), "class_id", "left").join(n, "class_id", "left")
        .select("id", "class_id", F.coalesce("g", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
