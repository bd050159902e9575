"""Problem 5: texts of varying length into containers of fixed capacity.

Method. A text longer than the capacity is cut into pieces of the capacity and one rest. The lengths of all items make a
histogram whose size is bounded by the capacity, so it is the only thing the driver sees; each profile is solved in a task of its own. On it the configuration linear
program (fewest containers, each filled by one configuration of length classes, that hold all items) is solved by
multiplicative weights: the price of a class is multiplied by exp(-RATE * (its coverage - the schedule)) in every round, a
knapsack dynamic program finds the configuration of greatest price, and a share of the containers takes it, less where that
would cover more than a part of a class. The
prices also give a lower bound on the number of containers. The amounts of the configurations are rounded along their running
sum and the program is solved again for the items that this leaves; the last few are packed by one knapsack a container.

Classes are lengths rounded up to a grid of ``GRID`` steps of the capacity. Rows get their rank within their class in
slices (see ranking), and the table of configurations, bounded by the grid and the rounds, maps ranks to containers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.functions.tokens import VOCABULARY, token_count
from corpusops.operators.ranking import running_total
from corpusops.runtime import written

GRID = 512
ROUNDS = 300
RATE = 12.0
#: No round covers more than this part of a class; rounds end after so many.
STEP, MOST_ROUNDS = 0.3, 1500
#: Rounds when the program is solved again, and containers of such a turn from which on it is left.
LATER_ROUNDS, FEW = 100, 2
ROWS_A_SLICE = 100_000


@dataclass
class Plan:
    """Per class, the ranks from which a run of containers takes its items."""

    start: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    containers: int
    from_program: int
    bound: int


def knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> np.ndarray:
    """Number of each class in the configuration of greatest price that fits, by dynamic programming over the room."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    s, p = sizes[order], prices[order]
    worth = p > np.concatenate([[-1.0], np.maximum.accumulate(p)[:-1]])  # a class is of no use where a smaller one is worth as much
    order, s, p = order[worth], s[worth], p[worth]
    upto = np.searchsorted(s, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = best[c - s[:k]] + p[:k]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], choice[c] = got[i], i
    out, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[order[choice[c]]] += 1
            c -= s[choice[c]]
    return out


def program(sizes: np.ndarray, counts: np.ndarray, room: int, rounds: int = ROUNDS, rate: float = RATE) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """The configurations of the linear program with their fractional amounts, and the prices of the best lower bound."""
    base = sizes / room
    estimate = float((sizes * counts).sum() / room)
    cover, best, mean = np.zeros(len(sizes)), base, np.zeros(len(sizes))
    for small in sizes[2 * sizes <= room]:  # threshold prices: items that leave no room for a kept one count whole, smaller than kept ones nothing
        threshold = np.where(sizes > room - small, 1.0, np.where(sizes < small, 0.0, base))
        best = max(best, threshold, key=lambda p: float((p * counts).sum()))
    bound = float((best * counts).sum())
    used: dict[bytes, list] = {}
    done, r = 0.0, 0
    while done < 1 and r < MOST_ROUNDS:
        r += 1
        price = base * np.exp(-rate * (cover - done))
        take = knapsack(sizes, price, room)
        price = price / (price * take).sum()  # no configuration is worth more than 1, nor is it under a mean of such prices
        mean += price
        if (lower := float((price * counts).sum())) > bound:
            bound, best = lower, price
        has = take > 0
        amount = min(estimate / rounds, STEP * float((counts[has] / take[has]).min()))
        done += amount / estimate
        cover += take * amount / counts
        used.setdefault(take.tobytes(), [take, 0.0])[1] += amount
    mean /= r
    return [(take, amount) for take, amount in used.values()], mean if float((mean * counts).sum()) > bound else best


def solve(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[list[tuple[np.ndarray, int]], int, np.ndarray]:
    """(configurations with their number of containers, containers that the program gave, prices) for classes of given sizes and counts.

    Amounts are rounded to whole numbers along their running sum, largest first, as far as there are items; then
    the program is solved again for the items left, until it gives no more. The few items after that are packed by one
    knapsack a container. Items that fit with no other have a container each, with the price 1.
    """
    left, prices, rounds = counts.astype(np.int64).copy(), sizes / room, ROUNDS
    alone = sizes + sizes.min(initial=room) > room
    plan = [(np.eye(1, len(sizes), i, dtype=np.int64)[0], int(left[i])) for i in np.flatnonzero(alone)]
    given = int(left[alone].sum())
    left[alone], prices[alone], first = 0, 1.0, True
    while len(open_ := np.flatnonzero(left)):
        amounts, price = program(sizes[open_], left[open_], room, rounds)
        if first:
            prices[open_], first = price, False
        running, before = 0.0, given
        for take, amount in sorted(amounts, key=lambda x: -x[1]):
            whole = int(running + amount + 1e-9) - int(running + 1e-9)
            running += amount
            has = take > 0
            whole = min(whole, int((left[open_[has]] // take[has]).min()))
            if whole > 0:
                full = np.zeros(len(sizes), np.int64)
                full[open_] = take
                plan.append((full, whole))
                left -= full * whole
                given += whole
        rounds = LATER_ROUNDS
        if given - before <= FEW:
            break
    while left.any():
        open_ = np.flatnonzero(left)
        base = sizes[open_] / room
        price = base * (1 + 0.25 * left[open_] / left[open_].max() + 0.25 * base)
        take = np.zeros(len(sizes), np.int64)
        take[open_] = np.minimum(knapsack(sizes[open_], price, room), left[open_])
        space = room - int((take * sizes).sum())
        for i in open_[np.argsort(-sizes[open_], kind="stable")]:  # room freed by the limit to the items left
            more = min(space // int(sizes[i]), int(left[i] - take[i]))
            if more > 0:
                take[i] += more
                space -= more * int(sizes[i])
        has = take > 0
        whole = max(1, int((left[has] // take[has]).min()))
        plan.append((take, whole))
        left -= take * whole
    return plan, given, prices


def make_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, separator: int, grid: int = GRID) -> tuple[Plan, int]:
    """The plan for items of the given lengths, and the step of its length classes."""
    room = capacity + separator  # every item brings one separator, the first needs none
    step = max(1, -(-room // grid))
    classes, where = np.unique(-(-(lengths + separator) // step), return_inverse=True)
    number = np.bincount(where, counts).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    cells = room // step
    over = classes > cells  # rounding up alone must not push an item out
    sizes = np.where(over, cells, classes)
    configurations, given, prices = solve(sizes, number, cells)
    start, first, each = ({int(c): [] for c in classes} for _ in range(3))
    taken, container = np.zeros(len(classes), np.int64), 0
    for take, whole in configurations:
        for i in np.flatnonzero(take):
            c = int(classes[i])
            start[c].append(taken[i])
            first[c].append(container)
            each[c].append(take[i])
            taken[i] += take[i] * whole
        container += whole
    as_arrays = [{c: np.array(v, np.int64) for c, v in x.items()} for x in (start, first, each)]
    return Plan(*as_arrays, container, given, _lower_bound(lengths + separator, counts, prices[where] if len(lengths) else lengths, room, step)), step


def _lower_bound(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, room: int, step: int) -> int:
    """Containers that no packing can go below: the volume, or the dual value of the prices.

    Items that fit with no other count on their own. For the dual value the lengths are rounded down to the grid, so that it holds
    for the true lengths as well.
    """
    if not len(lengths):
        return 0
    alone = lengths + lengths.min() > room
    own = int(counts[alone].sum())
    lengths, counts, prices = lengths[~alone], counts[~alone], prices[~alone]
    if not len(lengths):
        return own
    volume = -(-int((lengths * counts).sum()) // room)
    cells, where = np.unique(lengths // step, return_inverse=True)
    top = np.zeros(len(cells))
    np.maximum.at(top, where, prices)
    most = float(top @ knapsack(cells, top, room // step)) if cells[0] > 0 else np.inf
    return own + max(volume, int(np.ceil((prices * counts).sum() / most - 1e-6)))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plan of each profile, pickled; profiles are solved side by side."""
    for batch in batches:
        rows = batch.to_pylist()
        made = [pickle.dumps(make_plan(np.array(r["lengths"], np.int64), np.array(r["counts"], np.int64), r["capacity"], r["separator"])[0]) for r in rows]
        yield pa.record_batch([batch.column("profile"), pa.array(made, pa.binary())], ["profile", "plan"])


def _assign(plans: dict[str, Plan]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            profile = batch.column("profile").dictionary_encode()
            code, names = profile.indices.to_numpy(zero_copy_only=False), profile.dictionary.to_pylist()
            kind, rank = batch.column("kind").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            out = np.zeros(batch.num_rows, np.int64)
            for key in np.unique(code.astype(np.int64) << 32 | kind):
                at = np.flatnonzero((code == key >> 32) & (kind == key & 0xFFFFFFFF))
                plan, c = plans[names[key >> 32]], int(key & 0xFFFFFFFF)
                run_ = np.searchsorted(plan.start[c], rank[at], "right") - 1
                out[at] = plan.first[c][run_] + (rank[at] - plan.start[c][run_]) // plan.each[c][run_]
            yield batch.select(["profile", "doc_id", "piece", "first_token", "n_tokens"]).append_column("container_id", pa.array(out))

    return run


def pack(sizes: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(containers, report) for sizes(doc_id, n_tokens) and profiles(profile, capacity_tokens, separator_tokens).

    containers(profile, doc_id, piece, first_token, n_tokens, container_id): one row for each text, or for each piece
    of a text that exceeds the capacity. A text without tokens (null or empty) takes no room and has a null
    container. report(profile, items, tokens, containers, from_program, least_containers, fill): ``from_program`` counts the
    containers of the rounded linear program, ``least_containers`` is a bound that no packing can beat, ``fill`` the share of all room that holds tokens or needed separators. Profiles
    with a null or non-positive capacity are left out; a null separator counts 0.
    """
    spark = sizes.sparkSession
    wanted = [
        (r[0], int(r[1]), int(r[2] or 0))
        for r in profiles.select("profile", "capacity_tokens", "separator_tokens").distinct().collect()  # a table of settings
        if r[0] is not None and r[1] is not None and r[1] > 0
    ]
    room = spark.createDataFrame([(p, c, s, max(1, -(-(c + s) // GRID))) for p, c, s in wanted], "profile string, capacity int, separator int, step int")
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    pieces = (
        sizes.select("doc_id", n.cast("bigint").alias("n"))
        .crossJoin(F.broadcast(room))  # a row for each profile: the settings table bounds it
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr("int((n - 1) div capacity)")))))
        .select(
            "profile", "doc_id", "piece", (F.col("piece").cast("bigint") * F.col("capacity")).alias("first_token"),
            F.least(F.col("capacity"), F.col("n") - F.col("piece").cast("bigint") * F.col("capacity")).cast("int").alias("n_tokens"),
            "separator", "step",
        )
    )
    items = pieces.where("n_tokens > 0").withColumn("kind", F.ceil((F.col("n_tokens") + F.col("separator")) / F.col("step")).cast("int"))
    counted = items.groupBy("profile", "n_tokens").agg(F.count("*").alias("n")).collect()  # at most the capacities' sum of rows
    histograms = {p: sorted((r[1], r[2]) for r in counted if r[0] == p) for p, _, _ in wanted}
    tasks = [(p, c, s, [x[0] for x in histograms[p]], [x[1] for x in histograms[p]]) for p, c, s in wanted]
    solved = spark.createDataFrame(tasks, "profile string, capacity int, separator int, lengths array<bigint>, counts array<bigint>").repartitionByRange(max(len(tasks), 1), "profile")
    plans, facts, total = {r.profile: pickle.loads(r.plan) for r in solved.mapInArrow(_solve, "profile string, plan binary").collect()}, [], 0
    for profile, capacity, separator in wanted:
        lengths, number = (np.array([x[i] for x in histograms[profile]], np.int64) for i in (0, 1))
        k, tokens = plans[profile].containers, int((lengths * number).sum())
        held = tokens + separator * (int(number.sum()) - k)
        facts.append((profile, int(number.sum()), tokens, k, plans[profile].from_program, plans[profile].bound, round(held / (k * capacity), 6) if k else None))
        total += int(number.sum())
    slices = max(1, total // ROWS_A_SLICE)
    ranked = running_total(items, ["profile", "kind"], ["doc_id", "piece"], F.lit(1), "rank", slices)
    schema = "profile string, doc_id bigint, piece int, first_token bigint, n_tokens int, container_id bigint"
    placed = ranked.select("profile", "doc_id", "piece", "first_token", "n_tokens", "kind", "rank").mapInArrow(_assign(plans), schema)
    empty = pieces.where("n_tokens <= 0").select("profile", "doc_id", "piece", "first_token", F.lit(0).alias("n_tokens"), F.lit(None).cast("bigint").alias("container_id"))
    report = spark.createDataFrame(facts, "profile string, items bigint, tokens bigint, containers bigint, from_program bigint, least_containers bigint, fill double")
    return placed.unionByName(empty), report


def document_sizes(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row, written once: all profiles read it. A null text has a null size."""
    return written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), token_count(F.col(text_col), vocabulary).alias("n_tokens")))
