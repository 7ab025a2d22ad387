"""Exam assembly for many users at once: quotas, interleaving, due-first picks.

A per-user random pick must not pair every user with the whole bank. The items of a stratum are numbered once, and each
request draws places from a permutation of its own (`permute`), which costs only the steps it takes. How many steps that
needs depends on what is excluded, so requests draw what they should need, and those still short draw more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import core as fx
from ..session import materialize
from . import permute, slices
from .classify import once
from .topicstats import topic_rows

# Items per area of a random exam, review cap.
QUOTA = {"matematica": 20, "fundamentos": 30, "tecnologia": 20}
DAILY_LIMIT = 20
RANDOM_LABEL = "Simulado aleatorio (70q)"


def truncation_label(prefix: str, shown, total) -> Column:
    shown, total = fx.col(shown), fx.col(total)
    suffix = F.when(total > shown, F.concat(F.lit(" de "), total.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit(prefix + " ("), shown.cast("string"), suffix, F.lit("q)"))


def by_year(questions: DataFrame) -> DataFrame:
    """Items of every exam year by number, ranked per (year, number) slice."""
    rows = questions.select("year", "question_id", "number", "bank_pos")
    ranked = slices.rank(rows, ["year"], "number", ["bank_pos"], out="pos")
    return ranked.select("year", "question_id", "number", F.col("pos").cast("int").alias("pos"))


def ring(questions: DataFrame, strata: list[str], seed: str) -> DataFrame:
    """The items of each stratum numbered from 0 in hash order (`_at`), with the stratum's size (`_n`).

    Ranked per hash bucket, so a stratum holding most of the bank is not sorted by one task.
    """
    key = fx.hash_order(seed, "question_id")
    df = questions.withColumn("_h", key).withColumn("_b", F.substring("_h", 1, 3))
    ranked = slices.rank(df, strata, "_b", ["_h", "question_id"], out="_at", total="_n")
    return ranked.withColumn("_at", F.col("_at") - 1).drop("_h", "_b")


def draw(requests: DataFrame, bank_ring: DataFrame, strata: list[str], seed: str, accept=None, request="user_id") -> DataFrame:
    """`need` random items per request row (request, strata, need, optionally skip), in the order drawn (`_r`, from 1).

    Every request shuffles the stratum for itself. `accept` filters drawn rows (all columns of the request and the item);
    `skip` is how many items of the stratum it is expected to refuse. Requests draw in passes: first what should do, with
    three deviations to spare, then three times as many steps if they are still short, up to the whole stratum, so the
    result is exact and the steps stay in proportion to what is served and refused.
    """
    bank_ring = materialize(bank_ring, "ring")
    sizes = bank_ring.groupBy(*strata).agg(F.max("_n").alias("_n"))
    r = permute.with_keys(requests.filter("need > 0").join(sizes, strata), "_n", seed, request, *strata)
    zero = F.lit(0).cast("bigint")
    skip = F.col("skip") if "skip" in requests.columns else zero
    rate = F.greatest(F.col("_n") - skip, F.lit(1)) / F.col("_steps")
    first = F.ceil(F.col("need") / rate + 3 * F.sqrt(F.col("need") * (1 - rate)) / rate)
    r = r.withColumn("_from", zero).withColumn("_to", F.least(first, F.col("_steps")).cast("bigint"))
    if accept is None:  # only places beyond the end are refused, fewer than a row of digits: known before any item is met
        inside = lambda to: F.filter(permute.places_of(F.sequence(zero, to - 1)), lambda p: p < F.col("_n"))
        need = F.least("need", "_n")
        r = r.withColumn("_p", inside(F.col("_to"))).withColumn("_in", once("_p"))  # used more than once below
        sure = inside(F.least(need + F.col("_steps") - F.col("_n"), F.col("_steps")))
        r = r.withColumn("_p", F.slice(F.when(F.size("_in") >= need, F.col("_in")).otherwise(sure), F.lit(1), need.cast("int")))
        rows = r.withColumn("_in", once("_p")).select(request, *strata, "need", F.posexplode_outer("_in").alias("_r", "_at")).withColumn("_r", F.col("_r") + 1)
        return rows.join(bank_ring.drop("_n"), [*strata, "_at"]).drop("_at")
    helpers = ["_key", "_a", "_b", "_steps", "_from", "_to", "_n", "skip"]

    def walked(r: DataFrame) -> DataFrame:
        rows = r.withColumn("_step", F.explode(F.sequence("_from", F.col("_to") - 1)))
        rows = permute.place(rows, "_step", "_at").drop(*helpers)  # places beyond the end meet no item
        return rows.join(bank_ring.drop("_n"), [*strata, "_at"]).drop("_at")

    def served(rows: DataFrame) -> DataFrame:
        w = W.partitionBy(request, *strata).orderBy("_step")
        return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("need"))

    r, out = materialize(r.withColumn("_have", zero), "requests"), None
    while True:
        got = materialize(accept(walked(r)).select(request, *strata, "need", "question_id", "_step"), "drawn")
        out = got if out is None else out.unionByName(got)
        found = got.groupBy(request, *strata).agg(F.count("*").alias("_got"))
        r = r.join(found, [request, *strata], "left").withColumn("_have", F.col("_have") + F.coalesce("_got", zero)).drop("_got")
        r = r.filter("_have < need and _to < _steps").withColumn("_from", F.col("_to"))
        r = materialize(r.withColumn("_to", F.least(3 * F.col("_to"), F.col("_steps"))), "requests")
        if r.isEmpty():
            return served(out)


def pick(requests: DataFrame, bank: DataFrame, strata: list[str], seed: str, excluded: DataFrame | None = None,
         request="user_id") -> DataFrame:
    """`need` random items per (request, stratum), none of them in `excluded` (request, question_id)."""
    bank_ring = ring(bank.select("question_id", *strata), strata, seed)
    if excluded is None:
        return draw(requests, bank_ring, strata, seed, request=request)
    # only what concerns the drawn strata: it is counted once and met in every pass
    excluded = materialize(excluded.join(bank.select("question_id", *strata), "question_id"), "excluded")
    skips = excluded.groupBy(request, *strata).agg(F.count("*").alias("skip"))
    wanted = requests.join(skips, [request, *strata], "left").fillna(0, ["skip"])
    accept = lambda rows: rows.join(excluded, [request, "question_id"], "left_anti")
    return draw(wanted, bank_ring, strata, seed, accept, request)


def shuffled(picked: DataFrame, seed: str, request="user_id") -> DataFrame:
    """Final random order of each request's items as `pos`."""
    w = W.partitionBy(request).orderBy(fx.hash_order(seed, request, "question_id"), "question_id")
    return picked.withColumn("pos", F.row_number().over(w))


def correct_items(attempts: DataFrame) -> DataFrame:
    return attempts.filter("correct").select("user_id", "question_id").distinct()


def filters(questions: DataFrame, attempts: DataFrame | None, exclude_annulled: bool, exclude_correct: bool):
    """The two switches of every random exam: the usable bank, and what each user has answered correctly (or None)."""
    bank = questions.filter("not annulled") if exclude_annulled else questions
    return bank, correct_items(attempts) if exclude_correct else None


def random_exam(users: DataFrame, questions: DataFrame, attempts: DataFrame, seed: str, quota: dict[str, int] | None = None,
                exclude_annulled=True, exclude_correct=True) -> DataFrame:
    """Area quotas per user, then shuffled."""
    quota = QUOTA if quota is None else quota
    bank, excluded = filters(questions, attempts, exclude_annulled, exclude_correct)
    asks = F.explode(F.array(*[F.struct(F.lit(a).alias("area"), F.lit(n).cast("bigint").alias("need"))
                               for a, n in quota.items()]))
    requests = users.select("user_id", asks.alias("_q")).select("user_id", "_q.*")
    picked = shuffled(pick(requests, bank, ["area"], seed, excluded), seed)
    return picked.select("user_id", "pos", "question_id", "area", F.lit(RANDOM_LABEL).alias("label"))


def with_served(picked: DataFrame) -> DataFrame:
    """Add how many items the request got (`served`), which labels state."""
    return picked.withColumn("served", F.count("*").over(W.partitionBy("user_id")))


def area_exam(users: DataFrame, questions: DataFrame, attempts: DataFrame, areas: list[str], count: int, seed: str,
              exclude_annulled=True, exclude_correct=True) -> DataFrame:
    """`count` random items of the given areas per user (one pooled stratum)."""
    bank, excluded = filters(questions.filter(F.col("area").isin(areas)), attempts, exclude_annulled, exclude_correct)
    requests = users.select("user_id", F.lit("all").alias("pool"), F.lit(count).cast("bigint").alias("need"))
    picked = with_served(shuffled(pick(requests, bank.withColumn("pool", F.lit("all")), ["pool"], seed, excluded), seed))
    label = F.concat(F.lit(f"Pratica: {', '.join(areas)} ("), F.col("served").cast("string"), F.lit("q)"))
    return picked.select("user_id", "pos", "question_id", label.alias("label"))


def round_robin(ranked: DataFrame, limit: int, request="user_id") -> DataFrame:
    """Interleave ranked groups: one item per group and pass, exhausted groups skipped.

    Needs `group_pos` (order of the groups) and `rank` (1-based order inside the group). Taking
    item `rank` of each group in group order is the queue loop; only the first `limit` of a group
    can be served, so that bound is applied before the per-request ordering.
    """
    w = W.partitionBy(request).orderBy("rank", "group_pos")
    return (
        ranked.filter(F.col("rank") <= limit)
        .withColumn("pos", F.row_number().over(w))
        .filter(F.col("pos") <= limit)
    )


def topic_exam(selections: DataFrame, questions: DataFrame, count: int, seed: str, attempts: DataFrame | None = None,
               topics: DataFrame | None = None, exclude_annulled=True, exclude_correct=False) -> DataFrame:
    """Interleaved practice over each user's selected topics (user_id, slug).

    An item belongs to the first of its topics that the user selected; drawn items that belong elsewhere are refused. The
    user's selection travels along as an array (it holds at most the taxonomy), which keeps the bucket test a plain
    expression. `topics` gives the names for the label (else slugs), which are listed by slug.
    """
    bank, excluded = filters(questions, attempts, exclude_annulled, exclude_correct)
    bank = bank.select("question_id", F.posexplode("topics").alias("tpos", "slug"), "topics")
    bank = bank.select("question_id", "slug", F.slice("topics", F.lit(1), F.col("tpos")).alias("before"))
    sizes = bank.groupBy("slug").agg(F.count_if(F.size("before") == 0).alias("_sure"))  # no topic stands before these items' own
    selections = materialize(selections.select("user_id", "slug").distinct(), "selections")
    chosen = selections.groupBy("user_id").agg(F.sort_array(F.collect_set("slug")).alias("slugs"))
    requests = chosen.select("user_id", "slugs", F.explode("slugs").alias("slug")).join(sizes, "slug")
    if excluded is not None:
        excluded = materialize(excluded.join(bank.select("question_id", "slug"), "question_id"), "excluded")
        hits = excluded.groupBy("user_id", "slug").agg(F.count("*").alias("skip"))
        requests = requests.join(hits, ["user_id", "slug"], "left").fillna(0, ["skip"]).withColumn("_sure", F.col("_sure") - F.col("skip"))
    requests = shares(requests, "_sure", count).drop("_sure")

    def accept(rows: DataFrame) -> DataFrame:
        rows = rows.filter(~F.arrays_overlap("before", "slugs")).drop("before", "slugs")
        return rows if excluded is None else rows.join(excluded, ["user_id", "question_id"], "left_anti")

    ranked = draw(requests, ring(bank, ["slug"], seed), ["slug"], seed, accept).withColumnRenamed("_r", "rank")
    ranked = ranked.withColumn("group_pos", fx.hash_order(seed, "user_id", "slug"))
    picked = with_served(round_robin(ranked, count))
    named = selections.join(topics.select("slug", "label"), "slug", "left") if topics is not None else selections.withColumn("label", F.lit(None))
    pair = F.struct("slug", F.coalesce("label", "slug").alias("name"))
    named = named.groupBy("user_id").agg(F.sort_array(F.collect_list(pair))["name"].alias("_names"))
    label = F.concat(
        F.when(F.size("_names") > 1, "Intercalado: ").otherwise("Topico: "),
        F.array_join("_names", ", "), F.lit(" ("), F.col("served").cast("string"), F.lit("q)"),
    )
    return picked.join(named, "user_id").select("user_id", "pos", "question_id", "slug", label.alias("label"))


def shares(requests: DataFrame, available: str, limit: int, request="user_id") -> DataFrame:
    """Adds `need`: how many of a group's items an interleaved exam of `limit` places can serve, for groups of one request.

    Passes go on until `limit` items are served, and each takes one item of every group that still has one. `available`
    (a lower bound will do) tells after how many passes that is surely so; no group serves more items than there are passes.
    """
    sizes = F.collect_list(F.least(available, F.lit(limit))).over(W.partitionBy(request))  # one number per group of the request
    served = lambda r: F.aggregate("_sizes", F.lit(0).cast("bigint"), lambda acc, m: acc + F.least(m, r))
    passes = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(limit)), lambda r: served(r) >= limit))
    r = requests.withColumn(available, F.greatest(F.col(available).cast("bigint"), F.lit(0).cast("bigint"))).withColumn("_sizes", sizes)
    return r.withColumn("need", F.coalesce(passes, F.lit(limit)).cast("bigint")).drop("_sizes")


def review_candidates(topics_due: DataFrame, questions: DataFrame, seen: DataFrame, seed: str, limit: int | None = None) -> DataFrame:
    """The items to review per (user_id, slug, group_pos) row of `topics_due`, best first; with `limit` at least those that
    an interleaved exam of so many places serves.

    Order: items where the topic is primary, then secondary; within each, unseen ones in random
    order, then seen ones by oldest last sight; annulled items never.
    """
    strata = ["slug", "secondary"]
    rows = topic_rows(questions.filter("not annulled")).select(
        "question_id", "slug", (F.col("tpos") > 0).alias("secondary")
    )
    bank_ring = materialize(ring(rows, strata, seed), "ring")
    zero = F.lit(0).cast("bigint")
    first = F.col("secondary") == F.lit(False)
    sizes = bank_ring.groupBy("slug").agg(F.count_if(first).alias("_primary"), F.count_if(~first).alias("_secondary"))
    due = topics_due.select("user_id", "slug", "group_pos").join(sizes, "slug")
    if limit is not None:
        due = shares(due.withColumn("_all", F.col("_primary") + F.col("_secondary")), "_all", limit).drop("_all")
    due = materialize(due, "due")
    met = seen.filter("last_seen is not null").join(bank_ring.select("question_id", *strata, "_at"), "question_id")
    met = materialize(met.join(due.select("user_id", "slug"), ["user_id", "slug"]).select("user_id", *strata, "question_id", "_at", "last_seen"), "met")
    taken = met.groupBy("user_id", *strata).agg(F.count("*").alias("skip"), *([] if limit else [F.collect_list("_at").alias("_taken")]))
    requests = due.withColumn("secondary", F.explode(F.array(F.lit(False), F.lit(True))))
    requests = requests.join(taken, ["user_id", *strata], "left").fillna(0, ["skip"])
    # ranks before the stratum's first item, and before its first seen one
    requests = requests.withColumn("_before", F.when(first, zero).otherwise(F.col("_primary")))
    requests = requests.withColumn("_unseen", F.when(first, F.col("_primary")).otherwise(F.col("_secondary")) - F.col("skip"))
    if limit is not None:  # seen items are ranked after all unseen ones, secondary items after all primary ones
        requests = requests.withColumn("_room", F.col("need") - F.col("_before")).filter("_room > 0")
        requests = materialize(requests.drop("_primary", "_secondary"), "requests")
        asked = requests.withColumn("need", F.least("_room", "_unseen")).select("user_id", *strata, "need", "skip")
        accept = lambda r: r.join(met.select("user_id", "slug", "question_id"), ["user_id", "slug", "question_id"], "left_anti")
        fresh = draw(asked, bank_ring, strata, seed, accept).select("user_id", *strata, "question_id", "_r")
        fresh = fresh.join(requests.select("user_id", *strata, "group_pos", "_before"), ["user_id", *strata])
        fresh = fresh.withColumn("rank", F.col("_before") + F.col("_r"))
        reviewed = requests.filter("_unseen < _room and skip > 0")
    else:
        fresh, reviewed = _unseen_ranks(requests, bank_ring, strata, seed), requests.filter("skip > 0")
    met = met.drop("_at").join(reviewed.select("user_id", *strata, "group_pos", "_before", "_unseen"), ["user_id", *strata])
    w = W.partitionBy("user_id", *strata).orderBy("last_seen", "question_id")
    old = met.withColumn("rank", F.col("_before") + F.col("_unseen") + F.row_number().over(w))
    shown = lambda df, unseen: df.select("user_id", "slug", "group_pos", F.col("rank").cast("int").alias("rank"), "question_id",
                                         "secondary", F.lit(unseen).alias("unseen"))
    return shown(fresh, True).unionByName(shown(old, False))


def _unseen_ranks(requests: DataFrame, bank_ring: DataFrame, strata: list[str], seed: str) -> DataFrame:
    """All unseen items of each request's stratum with their rank, without sorting, shuffling or joining them.

    The steps at which a request meets a seen item or a place beyond the end are found by undoing the permutation, so a
    step's rank is known from how many of those precede it. A request meets its stratum as one list of items, from which
    each step takes one by its place, and the rounds of the permutation as lists of what they add. Only the requests are
    dealt out, and the lists with them, in a fixed number of partitions, since both are small beside the rows that come
    of them.
    """
    parts = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * requests.sparkSession.sparkContext.defaultParallelism)
    keys = [*strata, "_part"]
    lists = bank_ring.groupBy(*strata).agg(F.sort_array(F.collect_list(F.struct("_at", "question_id")))["question_id"].alias("_items"))
    lists = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, *keys)
    r = requests.withColumn("_n", F.col("_unseen") + F.col("skip")).filter("_n > 0")
    r = r.withColumn("_part", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")).repartition(parts, *keys)
    r = permute.with_sums(permute.with_keys(r.join(lists.hint("merge"), keys), "_n", seed, "user_id", *strata))
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    beyond = F.when(F.col("_steps") > F.col("_n"), F.sequence("_n", F.col("_steps") - 1)).otherwise(none)
    gone = F.concat(F.coalesce("_taken", none), beyond)
    r = r.withColumn("_gone", F.array_sort(permute.steps_of(gone, permute.listed))).drop("_taken").withColumn("_gone", once("_gone"))
    start = F.concat(F.array(zero), F.transform("_gone", lambda h: h + 1))
    runs = F.arrays_zip(start.alias("a"), F.concat("_gone", F.array(F.col("_steps"))).alias("b"))
    keep = ["user_id", *strata, "group_pos", "_before", "_a", "_b", "_items", *permute.SUMS]
    r = r.withColumn("_runs", once(runs)).select(*keep, F.posexplode("_runs").alias("_missed", "_run"))
    r = r.select(*keep, "_missed", F.col("_run.a").alias("_from"), F.col("_run.b").alias("_to")).filter("_from < _to")
    # a run of steps by its first digits, each with the second digits that belong to the run
    r = r.withColumn("_x", F.explode(F.sequence(F.floor(F.col("_from") / F.col("_b")), F.floor((F.col("_to") - 1) / F.col("_b")))))
    r = r.withColumn("_row", F.col("_x") * F.col("_b"))
    r = r.withColumn("_ahead", F.col("_before") + F.col("_row") - F.col("_missed") + 1)
    r = r.withColumn("_y", F.explode(F.sequence(F.greatest(F.col("_from") - F.col("_row"), zero), F.least(F.col("_to") - F.col("_row"), F.col("_b")) - 1)))
    r = r.withColumn("rank", F.col("_ahead") + F.col("_y"))
    return permute.place_by_sums(r, "_at").withColumn("question_id", F.col("_items")[F.col("_at")])


def topic_review(topics_due: DataFrame, questions: DataFrame, seen: DataFrame, seed: str, limit: int = DAILY_LIMIT,
                 topics: DataFrame | None = None, dedupe: bool = False) -> DataFrame:
    """Review exam over the due topics (user_id, slug, due_at), interleaved in a random order of topics, with its label.

    The label names up to two topics in due order, else their number. As many candidates of a topic as the exam can
    serve are drawn (`shares`), or all of them with `dedupe`, which may refuse any number.
    """
    due = materialize(topics_due.withColumn("group_pos", fx.hash_order(seed, "user_id", "slug")), "due-topics")
    ranked = review_candidates(due, questions, seen, seed, None if dedupe else limit)
    picked = with_served(topic_review_exam(ranked, limit, dedupe))
    named = due.join(topics.select("slug", "label"), "slug", "left") if topics is not None else due.withColumn("label", F.lit(None))
    entry = F.struct("due_at", "slug", F.coalesce("label", "slug").alias("name"))
    # a user's due topics are at most the taxonomy
    named = named.groupBy("user_id").agg(F.sort_array(F.collect_list(entry))["name"].alias("_names"))
    what = F.when(F.size("_names") <= 2, F.array_join("_names", " e ")).otherwise(F.concat(F.size("_names").cast("string"), F.lit(" temas")))
    label = F.concat(F.lit("Revisao: "), what, F.lit(" ("), F.col("served").cast("string"), F.lit("q)"))
    return picked.join(named, "user_id").select("user_id", "pos", "question_id", "slug", label.alias("label"))


def topic_review_exam(candidates: DataFrame, limit: int = DAILY_LIMIT, dedupe: bool = False) -> DataFrame:
    """Interleave the due topics' candidates.

    An item carrying two due topics may be served twice, as defined; `dedupe=True` keeps only its
    first place and is applied before the cap.
    """
    ranked = candidates
    if dedupe:
        w = W.partitionBy("user_id", "question_id").orderBy("rank", "group_pos")
        ranked = ranked.withColumn("_d", F.row_number().over(w)).filter("_d = 1").drop("_d")
        g = W.partitionBy("user_id", "slug").orderBy("rank")
        ranked = ranked.withColumn("rank", F.row_number().over(g))
    return round_robin(ranked, limit).select("user_id", "pos", "question_id", "slug")


def marked_exam(marks: DataFrame, questions: DataFrame, limit: int = DAILY_LIMIT) -> DataFrame:
    """Open marks of known items, oldest first, capped per user with the uncapped count beside."""
    open_ = marks.filter("resolved_at is null").join(questions.select("question_id"), "question_id", "left_semi")
    w = W.partitionBy("user_id").orderBy("created_at", "question_id")
    top = open_.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)
    totals = open_.groupBy("user_id").agg(F.count("*").alias("open_total"))
    return top.select("user_id", "pos", "question_id").join(totals, "user_id")


def create_sessions(picked: DataFrame, mode: str, label: Column, now: int, correction="exam", limit_seconds=None) -> DataFrame:
    """Empty session rows for assembled exams (`user_id`, `pos`, `question_id`). `label` may aggregate a user's rows."""
    limit = F.lit(limit_seconds).cast("int")
    return picked.groupBy("user_id").agg(
        label.alias("label"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "question_id"))), lambda s: s["question_id"]).alias(
            "question_ids"
        ),
    ).select(
        "user_id",
        F.md5(F.concat_ws(":", "user_id", F.lit(mode), F.lit(str(now)))).alias("session_id"),
        F.lit(mode).alias("mode"),
        "label",
        F.lit(now).cast("bigint").alias("created_at"),
        F.lit(None).cast("bigint").alias("finished_at"),
        F.lit(correction).alias("correction_mode"),
        limit.alias("time_limit_seconds"),
        "question_ids",
        F.lit(0).cast("bigint").alias("elapsed_seconds"),
    )


def quota_sample(questions: DataFrame, seed: str, quota: dict[str, int] | None = None) -> DataFrame:
    """One stratified sample of the bank: the first `quota[area]` of each area in random order."""
    quota = QUOTA if quota is None else quota
    limits = F.create_map(*[x for a, n in quota.items() for x in (F.lit(a), F.lit(n))])
    w = W.partitionBy("area").orderBy(fx.hash_order(seed, "question_id"))
    largest = max(quota.values())
    return (
        questions.filter(F.col("area").isin(list(quota)))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= largest)  # a literal bound lets Spark limit each group before the shuffle
        .filter(F.col("rank") <= F.element_at(limits, F.col("area")))
        .select("area", "question_id", "rank")
    )
