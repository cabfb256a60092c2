"""Best lineups under a salary cap as joins that a bound keeps small.

Give salary a price: a player is worth gain - price * salary. Of a lineup's shape (how many of each position), let the
bound be price * cap plus the best worths that each position could bring. Then

    points = bound - losses - price * (salary left)

where the loss of the players taken at a position is what their worths lack of the best ones there; nothing on the right
is negative but the bound. So once ``best`` lineups are known, the last of them with ``reach`` points, every lineup that
could still be among the best has losses of at most bound - reach in all, and all of those are joined together: players
to groups of a position, groups to lineups, each only while the losses so far leave room. The price that makes the bound
smallest is found per slate by three rounds over lists of prices; ``reach`` by lineups of the first few players of each
position. Brute force checks it, ties included.

Groups meet in bands of their loss: a band of one side meets only those of the other whose least losses together leave
room, so one slate's joins spread over as many keys as there are bands.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import counted
from ..session import cut_lineage

# Contest rules.
CAP = 50000
MAIN_SLOTS = {"QB": 1, "RB": 2, "WR": 3, "TE": 1, "RB/WR/TE": 1, "DST": 1}
SHOWDOWN_SLOTS = {"CPTN": 1, "FLEX": 5}
SHOWDOWN_TEAM_LIMIT = 5

#: Shares that groups of one position grow in, and bands of loss that groups meet in.
SHARES, BANDS = 16, 16
#: Players beyond the needed ones that the first lineups are made of, and how often more and cheaper ones are tried.
BEAM, TRIES = 1, 7
#: Players beyond the needed ones of the second lineups, which are only those better than the first.
WIDER = 4
#: Points count in millionths.
MILLION = 1_000_000
#: Room for the rounding of worths, in units of ``_gain``.
ROUNDING = 16.0


def read_slots(slots: dict[str, int]) -> tuple[dict[str, int], tuple[str, ...], int]:
    """Split slot rules into fixed counts per position and the one shared slot kind."""
    fixed = {pos: n for pos, n in slots.items() if "/" not in pos}
    shared = [(tuple(pos.split("/")), n) for pos, n in slots.items() if "/" in pos]
    if len(shared) > 1:
        raise ValueError("only one kind of shared slot is supported")
    eligible, extra = shared[0] if shared else ((), 0)
    if any(pos not in fixed for pos in eligible):
        raise ValueError("a shared slot needs a fixed slot of each of its positions")
    return fixed, eligible, extra


def lineup_shapes(slots: dict[str, int]) -> list[dict[str, int]]:
    """Every way to fill the slots: players per position."""
    fixed, eligible, extra = read_slots(slots)
    spread = [x for x in product(range(extra + 1), repeat=len(eligible)) if sum(x) == extra]
    return [{pos: n + dict(zip(eligible, more, strict=True)).get(pos, 0) for pos, n in fixed.items()} for more in spread]


def best_per_salary(pool: DataFrame, keys, depth: Column | int, most: int) -> DataFrame:
    """The ``depth`` best players of each salary, ``most`` at most; by that number each task cuts its own before the shuffle.

    Whoever takes a player with ``depth`` better ones at the same salary could take one of those instead.
    """
    order = Window.partitionBy(*keys, "cost").orderBy(F.col("gain").desc(), F.col("player").asc())
    numbered = pool.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.lit(most))
    return numbered.where(F.col("_n") <= depth).drop("_n")


def _scale(cap: int) -> int:
    return 1 << cap.bit_length()


def _gain(cap: int) -> Column:
    """A player's points in millionths, and of equals the cheaper first: a whole number, so sums don't depend on order.

    Summed over a lineup under the cap, it ranks by points and then by falling cost.
    """
    return F.round(F.round("fpts_proj", 6) * MILLION).cast("long") * _scale(cap) - F.col("salary")


def _points(cap: int) -> Column:
    return ((F.col("total") + F.col("cost")) / _scale(cap) / MILLION).alias("lineup_points")


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def _cheapest_bound(pool: DataFrame, slate, cap: int, bounds) -> DataFrame:
    """Slate columns, price, u and the other columns of ``bounds(prices)`` at the price with the smallest bound u.

    u is convex in the price, so the smallest of a coarse list of prices is next to the best one; two finer lists
    follow. Any price gives a valid bound. The coarse list goes far below the range of gains, as one position may have a
    range that grows with its teams (defences: with all passers faced) while the best price is set by the others.
    """
    widths = pool.groupBy(*slate).agg(((F.max("gain") - F.min("gain")) / F.lit(float(cap))).alias("price"))
    fine = 4.0 ** (1 / 8)
    found = widths
    for steps in (
        [0.0] + [4.0**j for j in range(-14, 9)], [fine**j for j in range(-8, 9)], [fine ** (j / 5) for j in range(-5, 6)]
    ):
        prices = found.select(*slate, F.explode(F.array_distinct(F.array(*[F.col("price") * x for x in steps]))).alias("price"))
        least = bounds(prices).where(F.col("u").isNotNull()).groupBy(*slate).agg(F.min(F.struct("u", "price")).alias("_least"))
        found = cut_lineage(least.select(*slate, F.col("_least.price").alias("price")))
    return cut_lineage(bounds(found))


def _with_ranks(rows: DataFrame, keys, most: int) -> DataFrame:
    """Adds rank within ``keys`` by worth, and ``tails``: the worths of the next 0, 1, ... players summed, null if fewer."""
    order = Window.partitionBy(*keys).orderBy(F.col("worth").desc(), F.col("cost").asc(), F.col("player").asc())
    tails = [F.lit(0.0)]
    for m in range(1, most):
        frame = order.rowsBetween(1, m)
        tails.append(F.when(F.count("worth").over(frame) == m, F.sum("worth").over(frame)))
    return rows.withColumn("rank", F.row_number().over(order)).withColumn("tails", F.array(*tails))


def _groups(rows: DataFrame, keys, carry, most: int, cap: int) -> DataFrame:
    """Groups of ``n`` players of each key whose loss leaves room: keys, carry, room, loss, cost, total, members.

    ``rows`` has keys, carry (the same in all rows of a key), n, top (the best n worths summed), room, rank, worth,
    tails, cost, gain, player. Players are added by falling worth. What is still to come is worth at most the players
    that follow next, so a group is dropped as soon as its loss is certain to exceed the room.
    """
    keys, carry = list(keys), list(carry)

    def fits(worth: Column, tails: Column, left: Column) -> Column:
        return F.col("top") - worth - F.element_at(tails, left + 1) <= F.col("room") + ROUNDING

    share = F.pmod(F.xxhash64("player"), F.lit(SHARES)).cast("int").alias("share")
    # What a player and the n - 1 best leave to be desired.
    others = F.sum(F.when(F.col("rank") < F.col("n"), F.col("worth")).otherwise(0.0)).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_behind", F.col("top") - others - F.col("worth")).where(
        (F.col("cost") <= cap) & (F.col("_behind") <= F.col("room") + ROUNDING)
    )
    rows = cut_lineage(
        rows.select(*keys, *carry, "n", "top", "room", "rank", "worth", "tails", "cost", "gain", "player")
    )
    grown = rows.where(fits(F.col("worth"), F.col("tails"), F.col("n") - 1)).select(
        *keys, *carry, share, "n", "top", "room", "rank", "worth", "cost", F.col("gain").alias("total"),
        F.array("player").alias("members"),
    )
    pool = rows.where(F.col("n") > 1).select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), F.col("rank").alias("_rank"),
        F.col("worth").alias("_worth"), F.col("tails").alias("_tails"), F.col("cost").alias("_cost"),
        F.col("gain").alias("_gain"), F.col("player").alias("_player"),
    )
    done = []
    for k in range(1, most + 1):
        done.append(grown.where(F.col("n") == k))
        if k == most:
            break
        worth = F.col("worth") + F.col("_worth")
        grown = grown.where(F.col("n") > k).join(pool, [*keys, "share"]).where(
            (F.col("_rank") > F.col("rank")) & (F.col("cost") + F.col("_cost") <= cap)
            & fits(worth, F.col("_tails"), F.col("n") - (k + 1))
        ).select(
            *keys, *carry, "share", "n", "top", "room", F.col("_rank").alias("rank"), worth.alias("worth"),
            (F.col("cost") + F.col("_cost")).alias("cost"), (F.col("total") + F.col("_gain")).alias("total"),
            F.array_append("members", F.col("_player")).alias("members"),
        )
        # Each size is made once, though the next ones and the result both read it.
        grown = cut_lineage(grown)
    whole = reduce(DataFrame.unionByName, done)
    loss = F.greatest(F.lit(0.0), F.col("top") - F.col("worth"))
    return whole.select(*keys, *carry, "room", loss.alias("loss"), "cost", "total", "members")


def _band(loss: str, room: str) -> Column:
    part = F.floor(F.col(loss) / F.col(room) * BANDS)
    return F.when(F.col(room) > 0, F.least(F.lit(BANDS - 1), part)).otherwise(F.lit(0)).cast("int")


def _meet(left: DataFrame, right: DataFrame, keys, cap: int) -> DataFrame:
    """Pairs of partial lineups of the same keys whose losses together leave room; columns of ``left``."""
    keys = list(keys)
    others = right.select(
        *keys, F.explode(F.sequence(F.lit(0), F.least(F.lit(BANDS - 1), BANDS - _band("loss", "room")))).alias("_band"),
        F.col("loss").alias("_loss"), F.col("cost").alias("_cost"), F.col("total").alias("_total"),
        F.col("members").alias("_members"),
    )
    met = left.withColumn("_band", _band("loss", "room")).join(others, [*keys, "_band"]).where(
        (F.col("loss") + F.col("_loss") <= F.col("room") + ROUNDING) & (F.col("cost") + F.col("_cost") <= cap)
    )
    sums = {c: F.col(c) + F.col(f"_{c}") for c in ("loss", "cost", "total")}
    joined = met.withColumns(sums | {"members": F.concat("members", "_members")})
    return joined.select(*left.columns)


def _number(whole: DataFrame, slate, best: int) -> DataFrame:
    """Number the best lineups of each slate: by points, cost, sorted members."""
    order = [F.col("total").desc(), F.array_sort("members").asc()]
    number = F.row_number().over(Window.partitionBy(*slate).orderBy(*order))
    return whole.withColumn("lineup", number).where(F.col("lineup") <= best)


def _with_reach(known: DataFrame, slate, best: int, first_lineups) -> DataFrame:
    """``known`` (one row per slate, with price) and reach: points of the ``best``-th of the first lineups.

    ``first_lineups(known, width)`` makes the lineups of the first players of each position; where they are too few
    under the cap, more players and a higher price, so cheaper players, are tried. Where none of that helps, reach is
    null and the search goes through all lineups of the slate.
    """
    missing, parts = known, []
    for i in range(TRIES):
        tried = missing.withColumn("price", F.col("price") * float(1 << i))
        last = _number(first_lineups(tried, BEAM + i), slate, best).where(F.col("lineup") == best)
        reached = cut_lineage(last.select(*slate, F.col("total").alias("reach")))
        parts.append(reached)
        missing = missing.join(reached, list(slate), "left_anti")
        if missing.isEmpty():
            break
        missing = cut_lineage(missing)
    return cut_lineage(known.join(reduce(DataFrame.unionByName, parts), list(slate), "left"))


def _closer_reach(known: DataFrame, slate, best: int, search) -> DataFrame:
    """``known`` with the reach of more players per position, where lineups with room are searched and a reach is known."""
    wider = search(known.where(F.col("reach").isNotNull()), WIDER)
    last = _number(wider, slate, best).where(F.col("lineup") == best).select(*slate, F.col("total").alias("_closer"))
    closer = known.join(last, list(slate), "left").withColumn("reach", F.greatest("reach", "_closer"))
    return cut_lineage(closer.drop("_closer"))


def _room(bound: str | Column) -> Column:
    """What losses may come to; without end where no reach is known."""
    bound = F.col(bound) if isinstance(bound, str) else bound
    return F.when(F.col("reach").isNull(), F.lit(float("inf"))).otherwise(bound - F.col("reach"))


def best_lineups(
    pool: DataFrame, slots: dict[str, int] = MAIN_SLOTS, cap: int = CAP, best: int = 1, slate=("slate",)
) -> DataFrame:
    """The ``best`` highest-scoring lineups of every slate, one row per member.

    ``pool`` needs the slate columns, player, position, salary, fpts_proj; its other columns are carried to the members.
    A player is known by player, position and, where the pool has it, team, once in a slate. Players without a score cannot be chosen. Points count to six digits; ties go
    to the cheaper lineup, then to the first by its sorted members. Jobs run while the result is built.
    """
    slate = list(slate)
    shapes = lineup_shapes(slots)
    most = {pos: max(shape[pos] for shape in shapes) for pos in shapes[0]}
    parts = sorted({(pos, n) for shape in shapes for pos, n in shape.items() if n})
    depth = F.lit(0)
    for pos, n in most.items():
        depth = F.when(F.col("section") == pos, n + best - 1).otherwise(depth)
    known_by = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("player", "team", "position") if c in pool.columns]
    pool = pool.withColumn("_id", F.concat_ws("\x1f", *known_by))
    priced = pool.where(
        F.col("position").isin(list(most)) & (F.col("salary") <= cap) & F.col("fpts_proj").isNotNull()
    ).select(
        *slate, F.col("position").alias("section"), F.col("_id").alias("player"), F.col("salary").alias("cost"),
        _gain(cap).alias("gain"),
    )
    kept = cut_lineage(best_per_salary(priced, [*slate, "section"], depth, max(most.values()) + best - 1))

    def bounds(prices: DataFrame) -> DataFrame:
        by = Window.partitionBy(*slate, "price", "section").orderBy(F.col("worth").desc())
        worth = (F.col("gain") - F.col("price") * F.col("cost")).alias("worth")
        tops = kept.join(prices, slate).select(*slate, "price", "section", worth)
        tops = tops.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(most.values()))
        sums = []
        for i, (pos, n) in enumerate(parts):
            taken = F.when((F.col("section") == pos) & (F.col("rank") <= n), F.col("worth"))
            sums.append(F.when(F.count(taken) == n, F.sum(taken)).alias(f"top_{i}"))
        summed = tops.groupBy(*slate, "price").agg(*sums)
        base = F.col("price") * F.lit(float(cap))
        us = [
            reduce(lambda a, b: a + b, [F.col(f"top_{parts.index(p)}") for p in shape.items() if p[1]], base)
            for shape in shapes
        ]
        return summed.select("*", *[u.alias(f"u_{j}") for j, u in enumerate(us)], _greatest(us).alias("u"))

    names = [f"{pos}{n}" for pos, n in parts]
    tops = [f"top_{i}" for i in range(len(parts))]

    def search(known: DataFrame, width: int | None = None) -> DataFrame:
        """All lineups that leave room, of the first players of each position only if ``width`` is given."""
        rooms = [_room(f"u_{j}") for j in range(len(shapes))]
        by_part = [_greatest([rooms[j] for j, s in enumerate(shapes) if s[pos] == n]) for pos, n in parts]
        facts = known.select(
            *slate, "price", F.array(*rooms).alias("rooms"), F.array(*by_part).alias("_rooms"), F.array(*tops).alias("_tops")
        )
        rows = kept.join(facts, slate).withColumn("worth", F.col("gain") - F.col("price") * F.col("cost"))
        rows = _with_ranks(rows, [*slate, "section"], max(most.values()))
        if width is not None:
            first = reduce(
                lambda a, p: F.when(F.col("section") == p, most[p] + width).otherwise(a), most, F.lit(0)
            )
            rows = rows.where(F.col("rank") <= first)
        kinds = F.array(*[
            F.struct(F.lit(name).alias("part"), F.lit(pos).alias("of"), F.lit(n).alias("n"), F.lit(i + 1).alias("at"))
            for i, (name, (pos, n)) in enumerate(zip(names, parts, strict=True))
        ])
        rows = rows.withColumn("_kind", F.explode(F.filter(kinds, lambda x: x["of"] == F.col("section"))))
        rows = rows.select(
            *slate, F.col("_kind.part").alias("part"), "price", "rooms", F.col("_kind.n").alias("n"),
            F.element_at("_tops", F.col("_kind.at")).alias("top"), F.element_at("_rooms", F.col("_kind.at")).alias("room"),
            "rank", "worth", "tails", "cost", "gain", "player",
        )
        groups = cut_lineage(_groups(rows, [*slate, "part"], ["price", "rooms"], max(most.values()), cap))
        state = None
        for pos in sorted(most, key=lambda p: (most[p], p)):
            of = {}
            for j, shape in enumerate(shapes):
                if shape[pos]:
                    of.setdefault(f"{pos}{shape[pos]}", []).append(j)
            shape_of = F.lit(None).cast("array<int>")
            for name, js in of.items():
                shape_of = F.when(F.col("part") == name, F.array(*map(F.lit, js))).otherwise(shape_of)
            side = groups.where(F.col("part").isin(list(of))).withColumn("shape", F.explode(shape_of))
            side = side.withColumn("room", F.element_at("rooms", F.col("shape") + 1)).drop("part", "rooms")
            state = side if state is None else _meet(state, side, [*slate, "shape"], cap)
        unused = F.col("price") * (F.lit(float(cap)) - F.col("cost"))
        return state.where(F.col("loss") + unused <= F.col("room") + ROUNDING)

    known = _cheapest_bound(kept, slate, cap, bounds)
    blank = F.lit(None).cast("double")
    known = _with_reach(known, slate, best, lambda some, width: search(some.withColumn("reach", blank), width))
    known = _closer_reach(known, slate, best, search)
    chosen = _number(search(known), slate, best).select(
        *slate, "lineup", _points(cap), F.col("cost").cast("bigint").alias("lineup_salary"),
        F.explode("members").alias("_id"),
    )
    return cut_lineage(counted(chosen)[0].join(pool, [*slate, "_id"]).drop("_id"))


def salary_profile(lineups: DataFrame, slate=("slate",), tops=(2, 3, 4, 5), mid=(4, 6)) -> DataFrame:
    """Per lineup: what its most expensive members cost and score, and its member list."""
    keys = [*slate, "lineup"]
    by_price = Window.partitionBy(*keys).orderBy(F.col("salary").desc(), F.col("player").asc())
    ranked = lineups.withColumn("_rank", F.row_number().over(by_price))
    aggs = [F.sum("fpts_proj").alias("lineup_score")]
    for k in tops:
        inside = F.col("_rank") <= k
        aggs += [
            F.sum(F.when(inside, F.col("salary"))).alias(f"top_{k}_spend"),
            F.sum(F.when(inside, F.col("fpts_proj"))).alias(f"top_{k}_score"),
        ]
    middle = F.col("_rank").between(*mid)
    aggs += [
        F.sum(F.when(middle, F.col("salary"))).alias("mid_3_spend"),
        F.sum(F.when(middle, F.col("fpts_proj"))).alias("mid_3_score"),
        F.array_join(F.sort_array(F.collect_set("player")), ", ").alias("players"),
    ]
    return ranked.groupBy(*keys).agg(*aggs)


def best_showdown_lineups(
    pool: DataFrame, cap: int = CAP, best: int = 1, flex: int = 5, team_limit: int = SHOWDOWN_TEAM_LIMIT,
    slate=("slate", "matchup"),
) -> DataFrame:
    """The ``best`` captain-and-flex lineups of every slate, one row per member.

    ``pool`` needs the slate columns, player (unique row id), player_id (shared by a captain row and its
    flex row), team, position (CPTN or FLEX), salary, fpts_proj. A player holds one slot only and at most ``team_limit``
    players are of one team. The flex players of each captain are a search of their own, with the captain's worth in
    its bound; captains whose bound does not reach are left out first. Ties as in ``best_lineups``.
    """
    slate = list(slate)
    priced = pool.where(
        F.col("position").isin("CPTN", "FLEX") & (F.col("salary") <= cap) & F.col("fpts_proj").isNotNull()
    ).select(
        *slate, "position", "team", F.col("player_id").alias("player"), F.col("salary").alias("cost"),
        _gain(cap).alias("gain"),
    )
    # Up to ``flex`` better ones of the team at the same salary may be in the lineup already, in the other role too.
    kept = cut_lineage(best_per_salary(priced, [*slate, "team", "position"], flex + best, flex + best))
    leads = kept.where(F.col("position") == "CPTN").select(
        *slate, F.col("player").alias("captain"), F.col("team").alias("lead_team"), F.col("cost").alias("lead_cost"),
        F.col("gain").alias("lead_gain"),
    )
    flexes = kept.where(F.col("position") == "FLEX").drop("position")
    worth = F.col("gain") - F.col("price") * F.col("cost")

    def captains(prices: DataFrame) -> DataFrame:
        """Each captain's bound u, top: the best worths of ``flex`` other players, and base: of one less.

        Where these would all be of the captain's team and one team may not fill a lineup, the last of them gives way to
        the best player of another team.
        """
        by = Window.partitionBy(*slate, "price").orderBy(F.col("worth").desc())
        by_team = Window.partitionBy(*slate, "price", "team").orderBy(F.col("worth").desc())
        first = flexes.join(prices, slate).select(*slate, "price", "player", "team", worth.alias("worth"))
        first = first.withColumn("rank", F.row_number().over(by)).withColumn("_of_team", F.row_number().over(by_team))
        entry = F.struct("worth", "player", "team")
        listed = first.where((F.col("rank") <= flex + 1) | (F.col("_of_team") == 1)).groupBy(*slate, "price").agg(
            F.sort_array(F.collect_list(F.when(F.col("rank") <= flex + 1, entry)), False).alias("_first"),
            F.collect_list(F.when(F.col("_of_team") == 1, entry)).alias("_leaders"),
        )
        own = F.slice(F.filter("_first", lambda x: x["player"] != F.col("captain")), 1, flex)
        top = F.aggregate("_own", F.lit(0.0), lambda a, x: a + x["worth"])
        if team_limit <= flex:
            others = F.transform(F.filter("_leaders", lambda x: x["team"] != F.col("lead_team")), lambda x: x["worth"])
            alone = F.forall("_own", lambda x: x["team"] == F.col("lead_team"))
            top = F.when(alone, top - F.element_at("_own", -1)["worth"] + F.array_max(others)).otherwise(top)
        sides = leads.join(listed, slate).withColumn("_own", own)
        base = F.aggregate(F.slice("_own", 1, flex - 1), F.lit(0.0), lambda a, x: a + x["worth"])
        sides = sides.select("*", F.when(F.size("_own") == flex, top).alias("top"), base.alias("base"))
        sides = sides.drop("_own", "_leaders")
        lead = F.col("lead_gain") - F.col("price") * F.col("lead_cost")
        return sides.withColumn("u", F.col("price") * F.lit(float(cap)) + lead + F.col("top")).drop("_first")

    def bounds(prices: DataFrame) -> DataFrame:
        """The best captain's and the best flex worths, the same player in both roles or not."""
        by = Window.partitionBy(*slate, "price", "position").orderBy(F.col("worth").desc())
        first = kept.join(prices, slate).select(*slate, "price", "position", worth.alias("worth"))
        # The first condition lets each task cut its own rows before they are moved.
        first = first.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(flex, 1))
        first = first.where(F.col("rank") <= F.when(F.col("position") == "FLEX", flex).otherwise(1))
        return first.groupBy(*slate, "price").agg(F.sum("worth").alias("_sum"), F.count("worth").alias("_n")).select(
            *slate, "price", F.when(F.col("_n") == flex + 1, F.col("price") * F.lit(float(cap)) + F.col("_sum")).alias("u")
        )

    def shapes(led: DataFrame, reach: DataFrame) -> DataFrame:
        """Rows per captain, shape (players of the captain's team) and side: own, n, top, base (the best n - 1) and room."""
        depth = 2 * flex + 2
        by_team = Window.partitionBy(*slate, "team").orderBy(F.col("worth").desc())
        prices = led.select(*slate, "price").distinct()
        first = flexes.join(prices, slate).select(*slate, "team", "player", worth.alias("worth"))
        first = first.withColumn("_n", F.row_number().over(by_team)).where(F.col("_n") <= depth)
        listed = first.groupBy(*slate).agg(F.sort_array(F.collect_list(F.struct("worth", "player", "team")), False).alias("_all"))

        def is_own(x: Column) -> Column:
            return F.coalesce(x["team"] == F.col("lead_team"), F.lit(False))

        def best_of(side: str, n: int) -> Column:
            """The best ``n`` but the captain; without leaving the captain out where the list is too short to tell."""
            if n <= 0:
                return F.lit(0.0)

            def total(x: Column) -> Column:
                return F.aggregate(F.slice(x, 1, n), F.lit(0.0), lambda a, y: a + y["worth"])

            free = F.filter(side, lambda x: x["player"] != F.col("captain"))
            return F.when(F.size(free) >= n, total(free)).when(F.size(side) >= depth, total(F.col(side)))

        sides = led.drop("top", "base", "u", "room", "reach").join(listed, slate).withColumns(
            {"_own": F.filter("_all", is_own), "_rest": F.filter("_all", lambda x: ~is_own(x))}
        )
        parts = []
        for j in range(min(flex, team_limit - 1) + 1):
            tops = {"_own": best_of("_own", j), "_rest": best_of("_rest", flex - j)}
            u = F.col("price") * F.lit(float(cap)) + F.col("lead_gain") - F.col("price") * F.col("lead_cost") + tops["_own"] + tops["_rest"]
            for side, n in (("_own", j), ("_rest", flex - j)):
                if n:
                    parts.append(F.struct(
                        F.lit(j).alias("shape"), F.lit(side == "_own").alias("own"), F.lit(n).alias("n"),
                        tops[side].alias("top"), best_of(side, n - 1).alias("base"), u.alias("u"),
                    ))
        split = sides.select(*[c for c in sides.columns if c not in ("_all", "_own", "_rest")], F.inline(F.array(*parts)))
        split = split.join(reach, slate).where(F.col("u").isNotNull()).withColumn("room", _room("u"))
        return cut_lineage(split.where(F.col("room") >= -ROUNDING).drop("u", "reach"))

    def search(known: DataFrame, width: int | None = None) -> DataFrame:
        """All lineups that leave room, of the first captains and flex players only if ``width`` is given.

        A lineup holds 0, 1, ... flex players of the captain's team and fills up with others. Each of these shapes has
        tops of its own for the two sides and so a bound of its own, as in ``best_lineups``: one bound over all would be
        that of lineups a team may not fill, and leave room for very many of them where one team is far ahead.
        """
        prices = known.select(*slate, "price", "reach")
        led = captains(prices.drop("reach")).join(prices.drop("price"), slate).where(F.col("top").isNotNull())
        led = led.withColumn("room", _room("u")).where(F.col("room") >= -ROUNDING)
        if width is not None:
            by = Window.partitionBy(*slate).orderBy(F.col("u").desc(), F.col("captain").asc())
            led = led.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= 2 + 2 * width).drop("_n")
        led = cut_lineage(led)
        by = Window.partitionBy(*slate).orderBy(F.col("worth").desc(), F.col("cost").asc(), F.col("player").asc())
        ranked = flexes.join(prices.select(*slate, "price"), slate).withColumn("worth", worth).drop("price")
        ranked = ranked.withColumn("_rank", F.row_number().over(by))
        if width is not None:
            of_team = F.row_number().over(Window.partitionBy(*slate, "team").orderBy(F.col("worth").desc(), F.col("player").asc()))
            ranked = ranked.withColumn("_of_team", of_team)
            ranked = ranked.where((F.col("_rank") <= flex + 2 + width) | (F.col("_of_team") <= width + 1)).drop("_of_team")
        led = shapes(led, prices.drop("price"))
        # With this player and the best others of that side, there must be room left.
        rows = led.join(ranked.drop("_rank"), slate).where(
            (F.col("player") != F.col("captain")) & (F.coalesce(F.col("team") == F.col("lead_team"), F.lit(False)) == F.col("own"))
            & (F.col("top") - F.col("base") - F.col("worth") <= F.col("room") + ROUNDING)
        )
        keys = [*slate, "captain", "shape", "own"]
        rows = _with_ranks(rows.drop("base"), keys, flex)
        rows = rows.withColumn("player", F.concat_ws("\x1f", "player", "team"))
        lead = ["price", "lead_team", "lead_cost", "lead_gain"]
        groups = cut_lineage(_groups(rows, keys, lead, flex, cap))
        alone = groups.where(F.col("shape").isin(0, flex)).drop("own")
        mixed = groups.where(~F.col("shape").isin(0, flex))
        mixed = _meet(mixed.where("own").drop("own"), mixed.where("NOT own"), [*slate, "captain", "shape"], cap)
        groups = alone.unionByName(mixed)
        teams = F.transform("members", lambda m: F.element_at(F.split(m, "\x1f"), 2))
        cost = F.col("cost") + F.col("lead_cost")
        unused = F.col("price") * (F.lit(float(cap)) - cost)
        whole = groups.withColumn("_teams", F.array_append(teams, F.col("lead_team"))).where(
            (cost <= cap) & (F.col("loss") + unused <= F.col("room") + ROUNDING)
            & F.forall(F.array_distinct("_teams"), lambda t: F.size(F.filter("_teams", lambda x: x == t)) <= team_limit)
        )
        names = F.transform("members", lambda m: F.concat(F.lit("FLEX:"), F.element_at(F.split(m, "\x1f"), 1)))
        return whole.select(
            *slate, cost.alias("cost"), (F.col("total") + F.col("lead_gain")).alias("total"),
            F.array_prepend(names, F.concat(F.lit("CPTN:"), F.col("captain"))).alias("members"),
        )

    known = _cheapest_bound(kept, slate, cap, bounds)
    blank = F.lit(None).cast("double")
    known = _with_reach(known, slate, best, lambda some, width: search(some.withColumn("reach", blank), width))
    chosen = _number(search(known), slate, best).select(
        *slate, "lineup", _points(cap), F.col("cost").cast("bigint").alias("lineup_salary"),
        F.explode("members").alias("_member"),
    ).select(
        *slate, "lineup", "lineup_points", "lineup_salary",
        F.substring("_member", 1, 4).alias("position"), F.expr("substring(_member, 6)").alias("player_id"),
    )
    return cut_lineage(counted(chosen)[0].join(pool, [*slate, "player_id", "position"]))
