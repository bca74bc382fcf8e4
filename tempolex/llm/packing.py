"""Filling containers of fixed capacity: bin completion with waste bounds."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stage


def byte_tokens(text: str = "text"):
    """Tokens of a byte-level vocabulary without merges: one per UTF-8 byte."""
    return F.octet_length(F.col(text))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the positions in each bin. The incumbent of the search, and its fallback."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in order:
        at = bisect_right(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            insort(rooms, (capacity - sizes[i], len(bins) - 1))
        else:
            room, b = rooms.pop(at)
            bins[b].append(i)
            insort(rooms, (room - sizes[i], b))
    return bins


def _fillings(kinds: list[int], counts: dict[int, int], room: int, waste: int, width: int, steps: int) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` that leave `waste` at most, the fullest first; `width` of them, found in `steps`.

    `kinds` are the open sizes, negated and ascending. Martello-Toth dominance in the form that is cheap to test: a
    filling is dropped if an item outside it fits into the room it leaves, or may take the place of a smaller one of
    its own.
    """
    kept: list[tuple[int, tuple[int, ...]]] = []
    n = len(kinds)
    done = 0

    def dominated(left: int, chosen: tuple[int, ...]) -> bool:
        if not left:
            return False
        spare = lambda k: chosen.count(-kinds[k]) < counts[-kinds[k]]
        if any(spare(k) for k in range(bisect_left(kinds, -left), n)):
            return True
        return any(spare(k) for x in set(chosen) for k in range(bisect_left(kinds, -x - left), bisect_left(kinds, -x)))

    # Depth first, the larger item and the more copies of it first; without recursion, as a container may hold
    # thousands of items. An entry: place among the kinds, room left, chosen, copies to take of the kind (None: most).
    stack: list[tuple[int, int, tuple[int, ...], int | None]] = [(0, room, (), None)]
    while stack and done < steps and len(kept) < width:
        at, left, chosen, copies = stack.pop()
        done += 1
        at = max(at, bisect_left(kinds, -left))
        if at == n:
            if left <= waste and not dominated(left, chosen):
                kept.append((left, chosen))
            continue
        size = -kinds[at]
        if copies is None:
            copies = min(counts[size], left // size)
        if copies:
            stack.append((at, left, chosen, copies - 1))
        stack.append((at + 1, left - copies * size, chosen + (size,) * copies, None))
    kept.sort(key=lambda x: (x[0], len(x[1])))
    return list(dict.fromkeys(chosen for _, chosen in kept))


def bin_completion(sizes: list[int], capacity: int, node_limit: int = 5_000, width: int = 12, steps: int = 480) -> list[list[int]]:
    """Positions of `sizes` by bin, every bin within `capacity`.

    Branch and bound over bins, not items, from the first bin on: the largest open item is given an undominated
    filling, then the next one. A branch is cut when its waste exceeds what one bin less than the best solution known
    can afford; that solution is seeded with best-fit decreasing. The search ends, with a proof that no fewer bins do,
    at the lower bound ceil(sum / capacity), which best-fit may meet itself, or when all branches are cut. Its limits:
    `node_limit` bins opened, and for each the first `width` fillings found in `steps` steps; the best solution found
    stands then.
    """
    if any(s > capacity or s <= 0 for s in sizes):
        raise ValueError("sizes must be in 1..capacity")
    incumbent = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = -(-total // capacity)
    best_n, best = len(incumbent), None
    if best_n <= bound:
        return incumbent
    pools: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: -i):
        pools.setdefault(sizes[i], []).append(i)
    counts = {s: len(p) for s, p in pools.items()}
    kinds = sorted(-s for s in counts)
    nodes = 0

    def take(some: tuple[int, ...]) -> None:
        for s in some:
            counts[s] -= 1
            if not counts[s]:
                del kinds[bisect_left(kinds, -s)]

    def put(some: tuple[int, ...]) -> None:
        for s in some:
            if not counts[s]:
                insort(kinds, -s)
            counts[s] += 1

    chosen: list[tuple[int, ...]] = []

    def opened(waste: int) -> tuple | None:
        """The next bin: its largest item, its fillings, the waste before it; None where the branch ends."""
        nonlocal nodes, best, best_n
        nodes += 1
        if not kinds:
            if len(chosen) < best_n:
                best, best_n = list(chosen), len(chosen)
            return None
        allowed = (best_n - 1) * capacity - total - waste
        if allowed < 0:
            return None
        first = -kinds[0]
        take((first,))
        return first, iter(_fillings(kinds, counts, capacity - first, allowed, width, steps)), waste

    stack = [opened(0)]
    filled: list[tuple[int, ...] | None] = [None]
    while stack:
        first, fillings, waste = stack[-1]
        if filled[-1] is not None:
            put(filled[-1])
            chosen.pop()
            filled[-1] = None
        fill = None if nodes > node_limit or best_n <= bound else next(fillings, None)
        if fill is None:
            put((first,))
            stack.pop()
            filled.pop()
            continue
        take(fill)
        chosen.append((first, *fill))
        filled[-1] = fill
        if (child := opened(waste + capacity - first - sum(fill))) is not None:
            stack.append(child)
            filled.append(None)
    if best is None:
        return incumbent
    return [[pools[s].pop() for s in b] for b in best]


def pack_documents(
    docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 4_000_000, node_limit: int = 5_000, width: int = 12, steps: int = 480
) -> DataFrame:
    """Containers of at most `capacity` tokens (UTF-8 bytes), only a document above it being split.

    Result: block, bin_no (a container is the pair), doc_id, piece_no, start_token (first byte of the piece), n_tokens. Null and empty texts, and null ids, have nothing to place and give no row. A document above the capacity
    becomes pieces as full as whole characters allow; its last piece is packed with the other items. Repeated ids are
    packed as often as they occur. Other columns are ignored.

    Documents are dealt by a hash of their id into blocks of about `block_tokens`, each packed by bin_completion() with
    the given limits in one task: a block's open container wastes at most 1 in block_tokens / capacity, whatever the sources look like, and
    sizes alone are shuffled, not texts, and texts are read once.
    """
    if capacity < 4:
        raise ValueError("a container must hold any single character, 4 tokens")
    kind = docs.schema[id_col].dataType
    sized = docs.where(F.col(text_col).isNotNull() & (F.col(text_col) != "") & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"),
        byte_tokens(text_col).cast("bigint").alias("n"),
        F.when(byte_tokens(text_col) > capacity, F.col(text_col)).alias("long"),
    )
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n").cast("int").alias("n")))
    items = sized.select(
        "doc_id",
        F.posexplode(F.coalesce(_pieces(capacity)("long"), whole)).alias("piece_no", "p"),
    ).select("doc_id", "piece_no", F.col("p.start").alias("start_token"), F.col("p.n").alias("n_tokens"))
    # The sizes alone are written once, so the texts are read once.
    items = stage(items, "sizes")
    total = items.agg(F.sum(F.col("n_tokens").cast("bigint")).alias("t")).first()["t"] or 0
    blocks = max(1, round(total / block_tokens))
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)))
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("bin_no", T.IntegerType()), T.StructField("doc_id", kind)]
        + [T.StructField(n, t) for n, t in (("piece_no", T.IntegerType()), ("start_token", T.LongType()), ("n_tokens", T.IntegerType()))]
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no", "n_tokens"], kind="stable").reset_index(drop=True)
        bin_no = [0] * len(pdf)
        for b, members in enumerate(bin_completion(pdf["n_tokens"].tolist(), capacity, node_limit, width, steps)):
            for i in members:
                bin_no[i] = b
        pdf["bin_no"] = pd.Series(bin_no, dtype="int32")
        return pdf[["block", "bin_no", "doc_id", "piece_no", "start_token", "n_tokens"]]

    return items.select("block", "doc_id", "piece_no", "start_token", "n_tokens").groupBy("block").applyInPandas(pack, schema)


def _pieces(capacity: int):
    """Places of the pieces of a text above the capacity, cut between characters."""

    @F.pandas_udf("array<struct<start:bigint,n:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            raw, at, pieces = t.encode("utf-8"), 0, []
            while at < len(raw):
                end = min(at + capacity, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                pieces.append({"start": at, "n": end - at})
                at = end
            out.append(pieces)
        return pd.Series(out)

    return cut


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: n_containers, n_tokens, fill (share of the room used)."""
    bins = packed.groupBy("block", "bin_no").agg(F.sum("n_tokens").alias("used"))
    a = bins.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))
    return a.select("n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("fill"))
