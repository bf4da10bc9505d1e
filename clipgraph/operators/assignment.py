"""Least-cost one-to-one assignment per group, on cost tables with multiplicities.

Rows that are alike for the cost are one line with a count, so a group is as large as its
number of distinct kinds. Only listed pairs are ever touched: a group falls apart into the connected
components of its pairs, and each is solved by shortest augmenting paths over adjacency lists.
Of several optimal pairings the one that is smallest line by line is taken, so results do not
depend on the order of the input.
"""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs are compared as whole multiples of this.
UNIT = 1e-9

Pairs = list[list[tuple[int, int]]]  # for each left line its (right line, cost), rising


def component_labels(rows: np.ndarray, cols: np.ndarray, n: int, m: int) -> np.ndarray:
    """For each pair the number of its connected component, by label passing with pointer jumping."""
    at = cols + n
    label = np.arange(n + m)
    while True:
        least = np.minimum(label[rows], label[at])
        new = label.copy()
        np.minimum.at(new, label[rows], least)  # hook the roots
        np.minimum.at(new, label[at], least)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label[rows]
        label = new


class Flow:
    """Optimal flow from left lines (all of whose units leave) to right lines with room, and its prices.

    The last right line is the slack: units that stay unmatched, at ``slack`` each and at most ``spare`` of them.
    """

    def __init__(self, pairs: Pairs, supply: list[int], room: list[int], slack: int, spare: int):
        self.n, self.m = len(pairs), len(room) + 1
        last = self.m - 1
        self.pairs = [[*row, (last, slack)] if spare else row for row in pairs]
        self.supply, self.size = supply, [*room, spare]
        self.used = [0] * self.m
        self.flow: list[dict[int, int]] = [{} for _ in pairs]  # left line -> right line -> units
        self.back: list[set[int]] = [set() for _ in range(self.m)]  # right line -> left lines that use it
        self.left_price = [min(c for _, c in row) if row else 0 for row in self.pairs]
        self.price = [0] * self.m
        for line in range(self.n):
            left = supply[line]
            while left:
                left -= self._augment(line, left)

    def _move(self, line: int, right: int, units: int) -> None:
        flow = self.flow[line]
        now = flow.get(right, 0) + units
        if now:
            flow[right] = now
            self.back[right].add(line)
        else:
            del flow[right]
            self.back[right].discard(line)
        self.used[right] += units

    def _augment(self, start: int, left: int) -> int:
        """Send units of a left line along a cheapest path to a right line with room; how many went."""
        price, left_price = self.price, self.left_price
        reached = {start: 0}
        via_left: dict[int, int] = {}
        via_right: dict[int, int] = {}
        best = {}
        agenda = []
        for right, cost in self.pairs[start]:
            best[right] = cost - left_price[start] - price[right]
            via_left[right] = start
            agenda.append((best[right], right))
        heapify(agenda)
        done = {}
        while True:
            far, end = heappop(agenda)
            if end in done:
                continue
            done[end] = far
            if self.used[end] < self.size[end]:
                break
            for line in self.back[end]:
                if line in reached:
                    continue
                reached[line] = far
                via_right[line] = end
                base = far - left_price[line]
                for right, cost in self.pairs[line]:
                    if right not in done:
                        reach = base + cost - price[right]
                        if reach < best.get(right, reach + 1):
                            best[right] = reach
                            via_left[right] = line
                            heappush(agenda, (reach, right))
        for line, at in reached.items():
            left_price[line] += far - at
        for right, at in done.items():
            price[right] -= far - at
        path, right = [], end
        units = min(left, self.size[end] - self.used[end])
        while True:
            line = via_left[right]
            path.append((line, right, 1))
            if line == start:
                break
            right = via_right[line]
            path.append((line, right, -1))
            units = min(units, self.flow[line][right])
        for line, right, sign in path:
            self._move(line, right, sign * units)
        return units

    def settle(self) -> list[dict[int, int]]:
        """Make the flow the one that is smallest line by line among all optimal ones.

        Optimal flows use only tight pairs (cost equal to the two prices) and fill every right line
        whose price is below zero. Left lines are gone through in order; each takes as many units as
        it can of its first tight right line, then of the next, by cycles over tight pairs of later lines.
        """
        tight = [[r for r, c in row if c == self.left_price[i] + self.price[r]] for i, row in enumerate(self.pairs)]
        self.loose = {r for r in range(self.m) if self.price[r] == 0 and self.used[r]}
        for line, rights in enumerate(tight):
            for k, right in enumerate(rights):
                later = {r for r in rights[k + 1:] if self.flow[line].get(r)}
                while later:
                    if not (path := self._cycle(line, right, later, tight)):
                        break
                    end, steps, units = path
                    self._move(line, right, units)
                    for other, a, b in steps:
                        self._move(other, a, -units)
                        self._move(other, b, units)
                    self._move(line, end, -units)
                    for r in {right, end, *[x for s in steps for x in s[1:]]}:
                        if self.price[r] == 0 and self.used[r]:
                            self.loose.add(r)
                        else:
                            self.loose.discard(r)
                    later = {r for r in later if self.flow[line].get(r)}
        return self.flow

    def _cycle(self, line: int, right: int, later: set[int], tight: list[list[int]]):
        """A way to put one more unit on (line, right): which later right line gives it up, and what moves between.

        Goes over units of lines after ``line``, and once over free room: a right line with room takes
        a unit more, one that need not be full gives one up.
        """
        came: dict[int, tuple | None] = {right: None}
        queue = deque([right])
        opened = False
        while queue:
            at = queue.popleft()
            if at in later:
                steps, units, x = [], self.flow[line][at], at
                while came[x] is not None:
                    before, other = came[x]
                    if other is None:
                        units = min(units, self.size[before] - self.used[before], self.used[x])
                    else:
                        units = min(units, self.flow[other][before])
                        steps.append((other, before, x))
                    x = before
                return at, steps, units
            if not opened and self.used[at] < self.size[at]:
                opened = True
                for x in self.loose:
                    if x not in came:
                        came[x] = (at, None)
                        queue.append(x)
            for other in self.back[at]:
                if other > line:
                    for x in tight[other]:
                        if x not in came:
                            came[x] = (at, other)
                            queue.append(x)
        return None


def sparse_transport(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, supply: np.ndarray, demand: np.ndarray,
                     missing: float = 1.0) -> np.ndarray:
    """Units matched on each listed pair at least total cost, pairs not listed costing ``missing``.

    As many units are matched as the smaller side has, over listed or unlisted pairs; the least
    pairing, line by line, of all optimal ones is given, and a match counts as less than none.
    """
    return transport_groups(rows, cols, cost, supply, demand, np.zeros(len(supply), np.int64), np.zeros(len(demand), np.int64), missing)


def transport_groups(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, supply: np.ndarray, demand: np.ndarray,
                     line_group: np.ndarray, right_group: np.ndarray, missing: float = 1.0) -> np.ndarray:
    """``sparse_transport`` of many groups at once; lines are numbered by rising group, and pairs stay inside their group.

    Components are found for all groups together, and those with one line on a side are filled together, cheapest pairs first.
    """
    out = np.zeros(len(rows), np.int64)
    if not len(rows):
        return out
    price = np.rint(np.asarray(cost, float) / UNIT).astype(np.int64)
    blank = int(round(missing / UNIT))
    group, n = line_group[rows], int(line_group[-1]) + 1
    n_left, n_right = np.bincount(line_group, minlength=n), np.bincount(right_group, minlength=n)
    units_left, units_right = np.zeros((2, n), np.int64)
    np.add.at(units_left, line_group, supply)
    np.add.at(units_right, right_group, demand)
    # nothing is unlisted: all units of the smaller side go over listed pairs; else what stays unmatched pays for an unlisted pair
    complete = np.bincount(group, minlength=n) == n_left * n_right
    top = np.full(n, blank)
    np.maximum.at(top, group, price)
    dear = ~complete & (top > blank)  # listed pairs dearer than the others: these are needed, too
    for g in np.flatnonzero(dear).tolist():
        (line, line_end), (right, right_end) = (np.searchsorted(x, [g, g + 1]) for x in (line_group, right_group))
        part = np.flatnonzero(group == g)
        shape = (line_end - line, right_end - right)
        full = np.full(shape, blank)
        full[rows[part] - line, cols[part] - right] = price[part]
        units = sparse_transport(*np.divmod(np.arange(full.size), shape[1]), full.ravel() * UNIT, supply[line:line_end], demand[right:right_end])
        out[part] = units.reshape(shape)[rows[part] - line, cols[part] - right]
    open_ = np.flatnonzero(~dear[group])
    if not len(open_):
        return out
    rows, cols, price, group = rows[open_], cols[open_], price[open_], group[open_]
    label = np.unique(component_labels(rows, cols, len(supply), len(demand)), return_inverse=True)[1]
    n_pairs = np.bincount(label)

    def of_lines(at: np.ndarray, size: int) -> np.ndarray:
        owner = np.full(size, -1)
        owner[at] = label
        return np.bincount(owner[owner >= 0], minlength=len(n_pairs))

    lines, rights = of_lines(rows, len(supply)), of_lines(cols, len(demand))
    star = (np.minimum(lines, rights) == 1) & (n_pairs == np.maximum(lines, rights))
    one = np.flatnonzero(star[label])
    if len(one):
        single = lines[label[one]] == 1
        given, taken = supply[rows[one]], demand[cols[one]]
        order = np.lexsort((np.where(single, cols[one], rows[one]), price[one], label[one]))
        room = np.where(single, taken, given)
        limit = np.where(single, given, taken)
        out[open_[one]] = np.clip(limit - _before(room, label[one], order), 0, room)
    rest = np.flatnonzero(~star[label])
    rest = rest[np.lexsort((cols[rest], rows[rest], label[rest]))]
    if len(rest):
        starts = np.flatnonzero(np.r_[True, np.diff(label[rest]) != 0]).tolist()
        at_row, at_col, at_price, at_group = (x[rest].tolist() for x in (rows, cols, price, group))
        units = []
        for begin, end in zip(starts, [*starts[1:], len(rest)], strict=True):
            of = {r: j for j, r in enumerate(sorted(set(at_col[begin:end])))}
            to: dict[int, int] = {}
            pairs: Pairs = []
            for k in range(begin, end):
                if at_row[k] not in to:
                    to[at_row[k]] = len(pairs)
                    pairs.append([])
                pairs[-1].append((of[at_col[k]], at_price[k]))
            g = at_group[begin]
            if complete[g]:
                slack, spare = 0, max(0, int(units_left[g] - units_right[g]))
            else:
                slack, spare = blank, int(units_left[g])
            flow = Flow(pairs, supply[list(to)].tolist(), demand[list(of)].tolist(), slack, spare).settle()
            units += [flow[to[i]].get(of[j], 0) for i, j in zip(at_row[begin:end], at_col[begin:end])]
        out[open_[rest]] = units
    return out


def _before(units: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Units of the same group that come earlier in ``order``."""
    if not len(order):
        return units
    sums = np.cumsum(units[order]) - units[order]
    first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    out = np.empty_like(units)
    out[order] = sums - np.repeat(sums[first], np.diff(np.r_[first, len(order)]))
    return out


def assign_groups(
    costs: DataFrame,
    keys: list[str],
    left: str,
    right: str,
    cost: str = "cost",
    left_n: str | None = None,
    right_n: str | None = None,
    missing: float = 1.0,
) -> DataFrame:
    """Optimal assignment of each group of a cost table ``(keys, left, right, cost)``.

    Pairs not listed cost ``missing``. Returns the listed pairs that were matched with their
    ``cost``, the number of units ``n`` and the first unit on each side (``left_from``,
    ``right_from``), so that matched kinds can be spread over their rows.

    Costs are compared at nine decimals. Of several optimal pairings the first one is taken: the
    first left line gets as many units as it can of the first right line that an optimum allows it, then
    of the next, and so on line by line; being matched comes before being left over.
    """
    full = costs.select(
        *keys,
        F.col(left).alias(left),
        F.col(right).alias(right),
        F.col(cost).cast("double").alias("cost"),
        (F.col(left_n) if left_n else F.lit(1)).cast("bigint").alias("_ln"),
        (F.col(right_n) if right_n else F.lit(1)).cast("bigint").alias("_rn"),
    )
    fields = {f.name: f.dataType.simpleString() for f in full.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in (*keys, left, right)) + ", cost double, n bigint, left_from bigint, right_from bigint"

    columns = [*keys, left, right, "cost", "n", "left_from", "right_from"]

    def lines(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its line, by group and value, and for each line its group."""
        names, code = np.unique(values, return_inverse=True)
        found, at = np.unique(group * len(names) + code, return_inverse=True)
        return at, found // len(names)

    def solve(pieces: list[dict[str, np.ndarray]], starts: list[int]) -> pd.DataFrame:
        part = pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}
        size = len(part["cost"])
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, size]))
        rows, line_group = lines(group, part[left])
        cols, right_group = lines(group, part[right])
        supply = np.zeros(len(line_group), dtype=np.int64)
        demand = np.zeros(len(right_group), dtype=np.int64)
        supply[rows] = part["_ln"]
        demand[cols] = part["_rn"]
        units = transport_groups(rows, cols, part["cost"], supply, demand, line_group, right_group, missing)
        used = np.flatnonzero(units)
        rows, cols, units = rows[used], cols[used], units[used]
        made = {c: part[c][used] for c in (*keys, left, right, "cost")}
        made["n"] = units
        made["left_from"] = _before(units, rows, np.lexsort((cols, rows)))
        made["right_from"] = _before(units, cols, np.lexsort((rows, cols)))
        return pd.DataFrame({c: made[c] for c in columns})

    def run(batches):
        # Rows arrive sorted by key. The last group of a batch may go on in the next one; all others are solved together.
        held: list[dict[str, np.ndarray]] = []

        for batch in batches:
            if not len(batch):
                continue
            data = {c: batch[c].to_numpy() for c in batch.columns}
            new = np.zeros(len(batch), dtype=bool)
            new[0] = not held or any(data[k][0] != held[-1][k][-1] for k in keys)
            for k in keys:
                new[1:] |= data[k][1:] != data[k][:-1]
            starts = np.flatnonzero(new).tolist()
            if not starts:
                held.append(data)
                continue
            last = starts[-1]
            before = sum(len(p["cost"]) for p in held)
            if before + last:
                whole = [*held, {c: a[:last] for c, a in data.items()}]
                yield solve(whole, [*([0] if held else []), *[before + at for at in starts[:-1]]])
            held = [{c: a[last:] for c, a in data.items()}]
        if held:
            yield solve(held, [0])

    # Many small groups share one Python call; a task holds one group and one batch at a time.
    # Solving costs far more than the bytes show, so the partitions must not be merged by size.
    # Dealt by a hash of the keys: a repartition by the keys themselves is left out where a join before it is planned
    # with that partitioning, and when the join then becomes a broadcast at run time the groups are apart.
    tasks = int(costs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(tasks, F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInPandas(run, schema)
