"""Recurring command sequences that would make a runbook, with their parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.blocks import block_seconds, with_following, with_runs
from runlore.functions.redaction import is_sensitive
from runlore.functions.text import HOLE, SHELL_VARIABLES, bare, confidence, is_inspection, pieces, shape, think_seconds, tokens
from runlore.operators.work_sessions import with_sessions
from runlore.runtime import checkpointed, written

STEP_GAP_S = 900
LENGTHS = (2, 8)
MIN_SESSIONS, MAX_VARIABLES = 3, 2


def step_runs(history: DataFrame, block: int | None = None, lookers: tuple[str, ...] = ()) -> DataFrame:
    """Commands that change something, by session and by stretch without a long pause: ``run`` and ``part``. ``lookers``
    are programs that only look besides the known ones."""
    history = history.where("command is not null")
    block = block or block_seconds(history.select(F.coalesce("repo", F.lit("")).alias("repo_id"), "seq"), ["repo_id"], "seq")
    h = with_sessions(history, block=block)
    h = h.where(F.coalesce(F.col("exit_code") == 0, F.lit(True)) & (F.trim("command") != "") & ~is_inspection(F.col("command"), lookers))
    h = h.select("repo_id", "run", "seq", "command", "ts", "duration_ms", "repo", shape(F.col("command")).alias("shape"))
    pause = lambda prev: F.greatest(think_seconds(F.col("ts"), F.col("duration_ms"), prev["ts"]), F.lit(0)) > STEP_GAP_S
    return with_runs(h, ["repo_id", "run"], "seq", ["ts"], pause, into="part", block=block)


def frequent_grams(steps: DataFrame, block: int | None = None) -> DataFrame:
    """Stretches of 2 to 8 steps whose shapes recur in enough sessions: repo_id, h1, h2, run, seqs (of the latest time
    in each session). Only hashes of shapes take part: nearly all stretches occur in one session only."""
    lo, hi = LENGTHS
    s = steps.select("repo_id", "run", "part", "seq", "ts", F.xxhash64("shape").alias("sh"))
    s = with_following(s, ["repo_id", "run", "part"], "seq", hi - 1, ["seq", "ts", "sh"], block=block)
    s = s.select("repo_id", "run", F.concat(F.array(F.struct("seq", "ts", "sh")), F.col("following")).alias("steps")).where(F.size("steps") >= lo)
    s = s.withColumn("w", F.explode(F.transform(F.sequence(F.lit(lo), F.size("steps")), lambda n: F.slice(F.col("steps"), 1, n))))
    shapes = F.transform("w", lambda x: x["sh"])
    key = ["repo_id", "h1", "h2"]
    occ = s.select("repo_id", F.xxhash64("repo_id", shapes).alias("h1"), F.xxhash64(F.lit("second"), "repo_id", shapes).alias("h2"), "run", F.element_at("w", -1)["ts"].alias("ts"), F.transform("w", lambda x: x["seq"]).alias("seqs"))
    often = occ.select("h1", "h2", "run").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SESSIONS)
    latest = occ.join(often, ["h1", "h2"], "left_semi").groupBy(*key, "run").agg(F.max(F.struct("ts", "seqs")).alias("o"))
    return latest.select(*key, "run", "o.seqs")


def sequences(history: DataFrame, lookers: tuple[str, ...] = ()) -> DataFrame:
    """Stretches of 2 to 8 steps whose shape is in enough sessions, once per session (its latest): repo_id, shapes,
    run, ts, seq, commands, repo. Texts are fetched for these few only."""
    narrow = history.where("command is not null")
    block = block_seconds(narrow.select(F.coalesce("repo", F.lit("")).alias("repo_id"), "seq"), ["repo_id"], "seq")
    steps = written(step_runs(history, block, lookers), "steps")  # the one copy; later passes read the columns they need
    grams = written(frequent_grams(steps, block), "grams")
    at = grams.select("repo_id", "h1", "h2", "run", F.posexplode("seqs").alias("k", "seq"))
    texts = steps.select("repo_id", "seq", "command", "ts", "repo", "shape")
    rows = at.join(texts, ["repo_id", "seq"]).groupBy("repo_id", "h1", "h2", "run").agg(F.array_sort(F.collect_list(F.struct("k", "command", "ts", "repo", "shape", "seq"))).alias("r"))
    last = F.element_at("r", -1)
    of = lambda name: F.transform("r", lambda x: x[name])
    return rows.select("repo_id", of("shape").alias("shapes"), "run", last["ts"].alias("ts"), F.element_at("r", 1)["seq"].alias("seq"), of("command").alias("commands"), last["repo"].alias("repo"))


def parameter_name(text: Column) -> Column:
    """UPPER_SNAKE of a word; null where that is no usable name of a parameter."""
    n = F.upper(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.when(F.rlike(n, F.lit("^[A-Z][A-Z0-9_]+$")) & ~n.isin(*SHELL_VARIABLES), n)


def _kind(values: Column) -> Column:
    """What all values have in common, if it has a name: versions or files."""
    plain = F.transform(values, lambda v: F.regexp_replace(v, "^[\"']+|[\"']+$", ""))
    every = lambda rx: F.forall(plain, lambda v: F.rlike(v, F.lit(rx)))
    return F.when(every(r"^v?\d+(\.\d+){0,3}$"), "VERSION").when(every(r"^[^\s:]+\.[A-Za-z][A-Za-z0-9]{0,5}$"), "FILE")


def slots(occ: DataFrame) -> DataFrame:
    """The places where the sessions of a sequence differ: repo_id, shapes, step, at, vec, vals (newest first), flag.

    What a place took over the sessions is summed up as a hash of (session, value) pairs, so equal vectors are found
    without gathering the occurrences. ``flag`` names the long option in front of the place.
    """
    key = ["repo_id", "shapes"]
    per_step = occ.select(*key, "run", "ts", F.posexplode(F.arrays_zip("commands", "shapes")).alias("step", "z"))
    pairs = F.arrays_zip(F.col("z.shapes").alias("e"), tokens(F.col("z.commands")).alias("t"))
    slot = per_step.select(*key, "run", "ts", "step", F.posexplode(pairs).alias("at", "p")).where(F.endswith(F.col("p.e"), F.lit(HOLE)))
    value = F.when(F.col("p.e") == HOLE, F.col("p.t")).otherwise(F.substr(F.col("p.t"), F.length("p.e")))
    val = slot.groupBy(*key, "step", "at", value.alias("value")).agg(F.max("ts").alias("last"), F.sum(F.xxhash64("run", value).cast("decimal(38,0)")).alias("h"))
    newest_first = F.transform(F.sort_array(F.collect_list(F.struct("last", "value")), False), lambda r: r["value"])
    place = val.groupBy(*key, "step", "at").agg(F.count("*").alias("n"), F.xxhash64(F.sum("h")).alias("vec"), newest_first.alias("vals")).where("n > 1")
    entry = lambda k: F.try_element_at(F.try_element_at("shapes", F.col("step") + 1), F.col("at") + k)
    option = F.when(entry(1) == HOLE, F.when(F.col("at") > 0, entry(0))).otherwise(F.substring_index(entry(1), "=", 1))
    return place.select(*key, "step", "at", "vec", "vals", F.when(F.startswith(option, F.lit("--")), parameter_name(F.substr(option, F.lit(3)))).alias("flag"))


def parameters(places: DataFrame) -> DataFrame:
    """The parameters of each sequence in order of their first place: repo_id, shapes, params (name, values, places).

    Places with equal vectors took the same value in every session, so they are one parameter. It is named after the
    first long option in front of any of its places, else the kind of its values, else the verb of its first step;
    where two would have one name the later is numbered. Sequences with too many parameters are left out.
    """
    key = ["repo_id", "shapes"]
    at = F.struct("step", "at")
    one = places.groupBy(*key, "vec").agg(
        F.min(at).alias("first"), F.min(F.when(F.col("flag").isNotNull(), F.struct("step", "at", "flag"))).alias("f"), F.min_by("vals", at).alias("vals"), F.collect_list(at).alias("places")
    )
    verb = parameter_name(F.try_element_at(bare(F.try_element_at("shapes", F.col("first.step") + 1)), F.lit(2)))
    base = F.coalesce(F.col("f.flag"), _kind(F.col("vals")), F.concat(verb, F.lit("_ARG")), F.lit("ARG"))
    few = one.select(*key, F.struct("first", base.alias("base"), "vals", "places").alias("p")).groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("ps"))

    def numbered(p: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(F.col("ps"), F.lit(1), i), lambda q: q["base"] == p["base"]))
        return F.struct(F.when(earlier == 0, p["base"]).otherwise(F.concat_ws("_", p["base"], (earlier + 1).cast("string"))).alias("name"), p["vals"].alias("values"), p["places"].alias("places"))

    return few.where(F.size("ps") <= MAX_VARIABLES).select(*key, F.transform("ps", numbered).alias("params"))


def templates(commands: Column, shapes: Column, params: Column) -> Column:
    """Commands with the places of their parameters as $NAME, everything between the tokens as it was."""

    def step(command: Column, s: Column) -> Column:
        cut = pieces(command)
        lead = F.when(F.rlike(command, F.lit(r"^\s")), 1).otherwise(0)

        def piece(text: Column, j: Column) -> Column:
            at = ((j - lead) / 2).cast("int")
            here = F.filter(params, lambda p: F.array_contains(p["places"], F.struct(s.alias("step"), at.alias("at"))))
            entry = F.try_element_at(F.try_element_at(shapes, s + 1), at + 1)
            taken = ((j - lead) % 2 == 0) & (F.size(here) > 0)
            return F.when(taken, F.concat(F.regexp_replace(entry, HOLE + "$", ""), F.lit("$"), F.try_element_at(here, F.lit(1))["name"])).otherwise(text)

        return F.array_join(F.transform(cut, piece), "")

    return F.transform(commands, step)


def candidates(history: DataFrame, lookers: tuple[str, ...] = ()) -> DataFrame:
    """Sequences of three or more sessions in which at most two things vary.

    Columns: repo_id, shapes, steps, variables, occurrences, first_seen, last_seen, repo.
    """
    occ = written(sequences(history, lookers), "occurrences")  # read three times below
    key = ["repo_id", "shapes"]
    newest = F.struct("ts", "seq")
    agg = occ.groupBy(*key).agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("repo", newest).alias("repo"), F.max_by("commands", newest).alias("commands"))
    agg = agg.where(F.col("occurrences") >= MIN_SESSIONS)
    places = slots(occ)
    varied = places.select(*key).distinct().withColumn("varies", F.lit(True))
    out = agg.join(varied, key, "left").join(parameters(places), key, "left").where("varies is null or params is not null")
    none = F.expr("filter(array(named_struct('name', '', 'values', array(''), 'places', array(named_struct('step', 0, 'at', 0)))), x -> false)")
    out = out.withColumn("params", F.coalesce("params", none))
    named = F.transform("params", lambda p: F.struct(p["name"].alias("name"), p["values"].alias("values")))
    return out.select(*key, templates(F.col("commands"), F.col("shapes"), F.col("params")).alias("steps"), named.alias("variables"), "occurrences", "first_seen", "last_seen", "repo")


def _parts(shapes: str, least: int, longest: Column) -> Column:
    """All stretches of an array with ``least`` to ``longest`` entries; at most 35 of eight steps."""
    n = F.size(shapes)
    return F.flatten(F.transform(F.sequence(F.lit(least), longest), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(F.col(shapes), i, k))))


def closed(cands: DataFrame) -> DataFrame:
    """Without the candidates whose every session is explained by a longer one.

    Each candidate gives its own contiguous parts (at most 27) once; a join on the part replaces a comparison of
    all pairs.
    """
    n = F.size("shapes")
    longer = cands.where(n > LENGTHS[0]).select("repo_id", "occurrences", F.explode(F.array_distinct(_parts("shapes", LENGTHS[0], n - 1))).alias("shapes"))
    top = longer.groupBy("repo_id", "shapes").agg(F.max("occurrences").alias("above"))
    return cands.join(top, ["repo_id", "shapes"], "left").where(F.col("above").isNull() | (F.col("above") < F.col("occurrences"))).drop("above")


def dominant(cands: DataFrame) -> DataFrame:
    """The best of each family of sequences that hold one another, then the best of what it leaves, and so on.

    Containment is a join on parts, so a candidate meets only those it holds. In each round the candidates that
    beat all they are in touch with are kept and those they touch are dropped; no repository's candidates come together
    in one task, and what has no relatives is decided at once.
    """
    size = F.col("occurrences") * F.size("steps")
    rank = F.struct((-size).alias("a"), (-F.col("occurrences")).alias("b"), (-F.col("last_seen")).alias("c"), F.col("steps").alias("d"))
    nodes = cands.select("repo_id", F.xxhash64("shapes").alias("id"), "shapes", rank.alias("rank"))
    inner = nodes.where(F.size("shapes") > LENGTHS[0]).select("repo_id", F.col("id").alias("a"), F.col("rank").alias("ra"), F.explode(F.array_distinct(_parts("shapes", LENGTHS[0], F.size("shapes") - 1))).alias("shapes"))
    held = inner.join(nodes.select("repo_id", "shapes", F.col("id").alias("b"), F.col("rank").alias("rb")), ["repo_id", "shapes"])
    both = held.select("repo_id", "a", "ra", "b", "rb").unionAll(held.select("repo_id", F.col("b"), F.col("rb"), F.col("a"), F.col("ra")))
    edges = checkpointed(both)
    dropped = None
    while not edges.isEmpty():
        best = edges.groupBy("repo_id", "a", "ra").agg(F.min("rb").alias("rb")).where("ra < rb").select("repo_id", F.col("a").alias("k"))
        out = edges.join(best, [edges["repo_id"] == best["repo_id"], edges["a"] == best["k"]], "left_semi").select("repo_id", F.col("b").alias("id")).distinct()
        gone = checkpointed(out)
        dropped = gone if dropped is None else dropped.unionAll(gone)
        kept = best.select("repo_id", F.col("k").alias("id")).unionAll(gone)
        for side in ("a", "b"):
            edges = edges.join(kept.withColumnRenamed("id", side), ["repo_id", side], "left_anti")
        edges = checkpointed(edges.select("repo_id", "a", "ra", "b", "rb"))
    if dropped is None:
        return cands
    return cands.withColumn("id", F.xxhash64("shapes")).join(dropped, ["repo_id", "id"], "left_anti").drop("id")


def promote(history: DataFrame, existing: DataFrame | None = None, limit: int = 5, lookers: tuple[str, ...] = ()) -> DataFrame:
    """The best candidates for runbooks, by steps saved, sessions, newness and text.

    ``existing`` (steps array<string>) are already saved and left out. Families are thinned per repository, on
    the closed candidates only.
    """
    c = dominant(checkpointed(closed(checkpointed(candidates(history, lookers)))))
    if existing is not None:
        c = c.join(existing.select("steps"), "steps", "left_anti")
    c = c.withColumn("saved", F.col("occurrences") * F.size("steps")).withColumn("has_credential", F.exists("steps", is_sensitive)).withColumn("confidence", confidence(F.col("occurrences"), 6, 3))
    out = c.orderBy(F.desc("saved"), F.desc("occurrences"), F.desc("last_seen"), "steps").limit(limit)
    return out.select("repo", "steps", "variables", "occurrences", "saved", "first_seen", "last_seen", "confidence", "has_credential")


def suggested_name(steps: Column) -> Column:
    """A name for a sequence after its last step: the program without path and suffix and, unless it is an option or a
    parameter, the base name of the word after it; ``routine`` in front of what does not begin with a letter."""
    words = bare(tokens(F.element_at(steps, -1)))
    base = lambda w: F.regexp_extract(w, "([^/]*)$", 1)
    program, word = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    usable = word.isNotNull() & ~F.contains(word, F.lit("$")) & (~F.startswith(word, F.lit("-")) | (word == "-"))
    joined = F.concat_ws("-", F.regexp_replace(base(program), r"\.[A-Za-z0-9]{1,6}$", ""), F.when(usable, base(word)))
    name = F.trim(F.regexp_replace(F.lower(joined), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.rlike(name, F.lit("^[a-z]")), name).otherwise(F.trim(F.concat(F.lit("routine-"), name), F.lit("-")))


def with_names(cands: DataFrame, order: list[Column], taken: DataFrame | None = None) -> DataFrame:
    """Rows with a ``name``, numbered from 2 where another row before it, or one of ``taken`` (name), has it."""
    named = cands.withColumn("__base", suggested_name(F.col("steps")))
    if taken is None:
        named = named.withColumn("__first", F.lit(1))
    else:  # past the numbers that are in use
        t = taken.select(F.regexp_replace("name", r"-[0-9]+$", "").alias("__base"), F.coalesce(F.regexp_extract("name", r"-([0-9]+)$", 1).try_cast("int"), F.lit(1)).alias("n"))
        named = named.join(t.groupBy("__base").agg((F.max("n") + 1).alias("__first")), "__base", "left").withColumn("__first", F.coalesce("__first", F.lit(1)))
    k = F.row_number().over(Window.partitionBy("__base").orderBy(*order)) - 1 + F.col("__first")
    return named.withColumn("name", F.when(k == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", k.cast("string")))).drop("__base", "__first")
