"""Human labelling: logs with undo, accuracy, progress, and queues."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.functions.text import keyed_hash
from veritally.operators.ranges import max_before, numbered, placed, stack_depth
from veritally.sources.files import written


def fold(actions, history: list | None = None) -> list[tuple]:
    """Standing (image, choice, seq) after submits and undos in order, on top of a history.

    A submit of a standing image is rejected; an undo takes back the latest standing submit, if
    there is one; an image taken back may be submitted again.
    """
    standing = list(history or [])
    seen = {s[0] for s in standing}
    for seq, action, image, choice in actions:
        if action == "undo":
            if standing:
                seen.discard(standing.pop()[0])
        elif action == "submit" and image not in seen:
            standing.append((image, choice, seq))
            seen.add(image)
    return standing


def _in_order(left: DataFrame, by: list[str], schema: str) -> DataFrame:
    """The fold of logs, one after another, by tasks that read them in order and hold the standing submits alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, standing = None, {}
        give = lambda: pd.DataFrame([(*at, image, choice, seq) for image, (choice, seq) in standing.items()], columns=[*by, "image_no", "choice", "seq"])
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                if row[: len(by)] != at:
                    if standing:
                        yield give()
                    at, standing = row[: len(by)], {}
                action, image, choice, seq = row[len(by) :]
                if action == "undo":
                    if standing:
                        standing.popitem()  # the latest, as a dict keeps the order of its keys
                elif image not in standing:
                    standing[image] = (choice, seq)
        if standing:
            yield give()

    # as text, since pandas has no integers beside nulls
    names = [*by, "action", "image_no", "choice", "seq"]
    rows = left.repartition(*by).sortWithinPartitions(*by, "place").select(*[F.col(c).cast("string").alias(c) for c in names])
    out = rows.mapInPandas(run, ", ".join(f"{c} string" for c in names if c != "action"))
    return out.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in T.StructType.fromDDL(schema)])


def human_standing(log: DataFrame, by: list[str] = ["evaluator"], rounds: int = 6) -> DataFrame:  # noqa: B006
    """by, image_no, choice, seq: the submits that stand at the end of each log, as ``fold`` gives them.

    log (by, seq, action, image_no, choice): actions in order of seq; others than submit and undo
    do nothing. A log is not folded in one task. Taking all submits as accepted, an undo takes
    back the latest submit at its depth of the stack (``ranges.stack_depth``; pushes and pops of a
    depth stand in turns, so they meet by their numbers), and a submit that falls between a submit of the
    same image and the undo of that is rejected. With those left out the undos match anew, until
    nothing changes; what comes before the first change is right, so this ends, and logs that
    are at rest leave the rounds. A log whose submits were all accepted is done in one, usual ones in
    two to five. The few that go on after ``rounds`` (many repeats on a deep stack) are read in order. by may be null.
    """
    types = {f.name: f.dataType.simpleString() for f in log.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in by) + f", image_no {types['image_no']}, choice {types['choice']}, seq {types['seq']}"
    acts = written(log.where("action in ('submit', 'undo')").select(*by, "seq", "action", "image_no", "choice", F.monotonically_increasing_id().alias("row")), "log")
    acts = placed(acts, by, ["seq", "row"], "log").drop("row").withColumn("ok", F.col("action") == "submit")
    out: list[DataFrame] = []
    forever = F.lit(2**62)
    for _ in range(rounds):
        step = F.when(F.col("action") == "undo", -1).when(F.col("ok"), 1).otherwise(0)
        deep = stack_depth(acts, by, step)
        # pushes and pops at one depth, which come in turns
        turns = deep.where("(action = 'undo' and taken) or ok").select(*by, F.col("place").alias("at"), "action", F.expr("depth + cast(action = 'undo' as int)").alias("level"))
        turns = numbered(placed(written(turns, "turns"), [*by, "level"], ["at"], "turns"), [*by, "level"], "turns")
        pops = turns.where("action = 'undo'").select(*[F.col(k).alias(f"_{k}") for k in by], F.col("level").alias("_level"), (F.col("pos") - 1).alias("_pos"), F.col("at").alias("end"))
        met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] + [F.col("level") == F.col("_level"), F.col("pos") == F.col("_pos")]
        ends = turns.where("action = 'submit'").join(pops, reduce(and_, met), "left").select("at", "end")
        # a submit is rejected where one of its image, before it, is taken back only after it
        submits = acts.where("action = 'submit'").withColumnRenamed("place", "at").drop("block").join(ends, "at", "left")
        submits = submits.withColumn("reach", F.when(F.col("ok"), F.coalesce("end", forever)))
        submits = max_before(placed(written(submits, "submits"), [*by, "image_no"], ["at"], "submits"), [*by, "image_no"], "reach", "covered")
        judged = submits.select(*by, "image_no", "choice", "seq", "at", "ok", "end", (F.coalesce("covered", F.lit(-1)) <= F.col("at")).alias("now"))
        judged = written(judged, "judged")
        open_ = written(judged.where("ok <> now").select(*by).distinct(), "open")
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
        marked = open_.select(*[F.col(k).alias(f"_{k}") for k in by])
        out.append(judged.join(marked, same, "left_anti").where("ok and end is null").select(*by, "image_no", "choice", "seq"))
        if not open_.limit(1).count():
            break
        acts = written(acts.join(marked, same, "left_semi").drop("ok").join(judged.select(F.col("at").alias("place"), F.col("now").alias("ok")), "place", "left").withColumn("ok", F.coalesce("ok", F.lit(False))), "log")
    else:
        out.append(_in_order(acts, by, schema))
    return reduce(DataFrame.unionByName, out)


def human_accuracy(records: DataFrame, by: list[str]) -> DataFrame:
    """by, bucket, gen_model, n, correct, accuracy; a row with bucket ``all`` for the whole of ``by``. One pass by grouping sets."""
    sets = records.groupingSets([[*by, "bucket", "gen_model"], by], *by, "bucket", "gen_model")
    sets = sets.agg(F.count("*").alias("n"), F.count_if(F.col("choice") == F.col("true_label")).alias("correct"), F.grouping("bucket").alias("_whole"))
    return sets.select(*by, F.when(F.col("_whole") == 1, "all").otherwise(F.col("bucket")).alias("bucket"), "gen_model", "n", "correct", F.try_divide("correct", "n").alias("accuracy"))


def _in_scope(catalog: DataFrame, scope: str) -> DataFrame:
    """The catalogue once for all (``All``) and once for its category."""
    return catalog.withColumn("scope", F.explode(F.array(F.lit("All"), F.col(scope))))


def seen_bitmaps(catalog: DataFrame, standing: DataFrame, key: str = "image_no", scope: str = "category") -> DataFrame:
    """evaluator, scope, true_label, bucket, seen: bitmaps of the catalogue's images that stand in a log, 32,768 numbers a bucket."""
    known = standing.join(_in_scope(catalog.select(key, scope, "true_label"), scope).select(key, "scope", "true_label"), [key, "scope"])
    return known.groupBy("evaluator", "scope", "true_label", F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("seen"))


def unseen_pools(catalog: DataFrame, standing: DataFrame, logs: DataFrame, key: str = "image_no", scope: str = "category") -> DataFrame:
    """evaluator, scope, evaluated, total, unseen_real, unseen_fake of every log, for the sampler.

    catalog (key, category, true_label, ...): key is an image's number, named once. standing and logs
    (evaluator, scope): scope is ``All`` or a category. Pools are the catalogue's counts by scope less
    what an evaluator's bitmaps hold, so no evaluator meets the catalogue. Standing submits
    of images outside the scope don't count; a scope without images has empty pools.
    """
    side = lambda c: [F.coalesce(F.sum(F.when(F.col("true_label") == x, F.col(c))), F.lit(0)).alias(f"{c}_{x}") for x in ("real", "fake")]
    there = _in_scope(catalog, scope).groupBy("scope", "true_label").agg(F.count("*").alias("there")).groupBy("scope").agg(*side("there"))
    seen = seen_bitmaps(catalog, standing, key, scope).withColumn("seen", F.bitmap_count("seen")).groupBy("evaluator", "scope").agg(*side("seen"))
    rows = logs.select("evaluator", "scope").distinct().join(seen, ["evaluator", "scope"], "left").join(there, "scope", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("evaluator", "scope", (n("seen_real") + n("seen_fake")).alias("evaluated"), (n("there_real") + n("there_fake")).alias("total"), (n("there_real") - n("seen_real")).alias("unseen_real"), (n("there_fake") - n("seen_fake")).alias("unseen_fake"))


def human_progress(catalog: DataFrame, standing: DataFrame, logs: DataFrame, key: str = "image_no", scope: str = "category") -> DataFrame:
    """evaluated and total per log; no numbers by class, which would tell what is left."""
    return unseen_pools(catalog, standing, logs, key, scope).select("evaluator", "scope", "evaluated", "total")


def labelling_queue(catalog: DataFrame, evaluators: DataFrame, seed: int, per_evaluator: int, key: str = "image_id") -> DataFrame:
    """evaluator, pos, key, true_label, ...: real and fake by turns, in a hashed order of each evaluator's own.

    Every image has a hash for every evaluator, and of each side the ``per_evaluator`` least are
    an evaluator's, in their order; catalog names an image once. Hashes are even, so those below a bound
    hold the least ones all but surely, and only these are sorted. Where they are too few, all
    other images of that side follow. A side that ends early leaves its places empty and positions stay dense.
    """
    catalog = written(catalog, "catalogue")
    sides = catalog.groupBy("true_label").agg(F.count("*").alias("_n"))
    who = evaluators.select("evaluator", F.explode(F.array(F.lit("real"), F.lit("fake"))).alias("true_label")).distinct().join(sides, "true_label")
    likely = per_evaluator + 10 * per_evaluator**0.5 + 50
    who = written(who.withColumn("_bound", F.expr(f"cast(1152921504606846976 * least(1, {likely} / _n) as bigint)")), "evaluators")
    hashed = lambda who: catalog.join(who, "true_label").withColumn("_h", keyed_hash(F.lit(str(seed)), "evaluator", key))
    rows = written(hashed(who).where("_h < _bound"), "queue")
    drawn = rows.groupBy("evaluator", "true_label").agg(F.count("*").alias("_drawn"))
    short = who.alias("w").join(drawn.alias("d"), F.expr("w.evaluator <=> d.evaluator and w.true_label = d.true_label"), "left").where(f"coalesce(_drawn, 0) < least({per_evaluator}, _n)").select("w.*")
    rows = rows.unionByName(hashed(written(short, "short")).where("_h >= _bound")).drop("_n", "_bound")
    rows = numbered(placed(rows, ["evaluator", "true_label"], ["_h", key], "queue"), ["evaluator", "true_label"], "queue")
    rows = rows.where(F.col("pos") < per_evaluator).drop("_h", "place", "block").withColumnRenamed("pos", "_r")
    pos = F.row_number().over(Window.partitionBy("evaluator").orderBy("_r", "true_label"))
    return rows.withColumn("pos", pos).where(F.col("pos") <= per_evaluator).drop("_r")


def recency_repeats(queue: DataFrame, review: list[str], window: int = 30) -> DataFrame:
    """Queue rows whose review came up within the last ``window`` places, and the gap."""
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("evaluator", *review).orderBy("pos"))
    return queue.withColumn("gap", gap).where(F.col("gap") <= window)
