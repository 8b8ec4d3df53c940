"""A paid fallback for fields that the rules do not find: a ledger of calls, a budget that is dealt out before any call, two attempts.

The provider is a function; without one nothing is called. Every call has a key of its document, attempt and
text. A task that runs again sends the same keys, so a provider that remembers keys is not asked, or paid, twice; calls that
the ledger has are never made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import written
from .extract import valid_fallback
from .running import running_sums

#: Attempts of a document: one, and another where nothing of the first could be used.
ATTEMPTS = 2
LEDGER = "id long, attempt int, call_key string, cost_cents long, answer string"
#: What an answer says of a field.
SAID = "struct<value:string,explicitly_stated:boolean,confidence:double,supporting_text:string>"

#: (call key, attempt, text) to (cost in cents, answer as JSON of fields, or None).
Provider = Callable[[str, int, str], tuple[int, str | None]]


def usable(answer: Column, kinds: dict[str, str]) -> Column:
    """A struct of an answer's fields, each checked by itself; null where it lacks or is not of its kind."""
    read = F.from_json(answer, "struct<" + ",".join(f"`{n}`:{SAID}" for n in kinds) + ">")
    return F.struct(*(valid_fallback(read[n], kind).alias(n) for n, kind in kinds.items()))


def _accepted(fields: Column, kinds: dict[str, str]) -> Column:
    return sum((F.coalesce(fields[n]["value"].isNotNull(), F.lit(False)).cast("int") for n in kinds), F.lit(0))


def dealt_calls(wanted: DataFrame, ledger: DataFrame, budget_cents: int, estimate: Column, kinds: dict[str, str]) -> DataFrame:
    """The calls (id, attempt, call_key, text) that are made next, of `wanted` (id, text), in order of ids.

    A document is asked again while no field of its answers could be used, ATTEMPTS times at most. What the ledger says was spent and the estimates of
    all calls before, its own included, stay within the budget: the cut is exact, and made before any call.
    """
    told = ledger.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("_made"), F.max(_accepted(usable(F.col("answer"), kinds), kinds)).alias("_accepted"))
    spent = ledger.agg(F.coalesce(F.sum("cost_cents"), F.lit(0)).alias("s")).first()["s"]
    open_ = wanted.join(told, "id", "left").where((F.coalesce("_made", F.lit(0)) < ATTEMPTS) & (F.coalesce("_accepted", F.lit(0)) == 0))
    asked = open_.select("id", (F.coalesce("_made", F.lit(0)) + 1).alias("attempt"), "text", estimate.cast("long").alias("_cents"))
    lean = running_sums(asked.select("id", "attempt", "_cents"), [], ["id"], F.col("_cents"), "_sum").where(F.col("_sum") + spent <= budget_cents)
    key = F.sha2(F.concat_ws("\x1f", "id", "attempt", "text"), 256)
    return lean.select("id", "attempt").join(asked, ["id", "attempt"]).select("id", "attempt", key.alias("call_key"), "text")


def _called(calls: DataFrame, provider: Provider) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            told = [provider(k, n, t or "") for k, n, t in zip(keys, batch.column(1).to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c for c, _ in told], pa.int64()), pa.array([a for _, a in told], pa.string())], ["id", "attempt", "call_key", "cost_cents", "answer"])

    return calls.mapInArrow(run, LEDGER)


def answered(wanted: DataFrame, provider: Provider | None, ledger: DataFrame, budget_cents: int, estimate: Column, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Per row of `wanted` (id, text; ids are unique): id, attempts, cost_cents, outcome and the answer's fields; and the ledger after it.

    Outcomes: ACCEPTED, NO_FIELDS (answers, but nothing of use), NO_ANSWER, BUDGET (a call that was due was not within the
    budget), NOT_CONFIGURED (no provider; nothing is called). Of several answers the last counts. `kinds` names the
    fields and what they are: text, number or date. Calls are in the ledger before the next attempt is dealt.
    """
    now = ledger.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in LEDGER.split(", ")))
    for _ in range(ATTEMPTS if provider else 0):
        made = written(_called(dealt_calls(wanted, now, budget_cents, estimate, kinds), provider), "calls")
        now = written(now.unionByName(made), "ledger")
    best = F.max_by(F.struct("answer"), F.col("attempt"))
    told = now.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("attempts"), F.sum("cost_cents").alias("cost_cents"), best.alias("_last"))
    out = wanted.select("id").join(told, "id", "left").withColumn("fields", usable(F.col("_last.answer"), kinds))
    attempts = F.coalesce("attempts", F.lit(0))
    outcome = (
        F.when(_accepted(F.col("fields"), kinds) > 0, "ACCEPTED").when(F.lit(provider is None), "NOT_CONFIGURED").when(attempts < ATTEMPTS, "BUDGET")
        .when(F.col("_last.answer").isNull(), "NO_ANSWER").otherwise("NO_FIELDS")
    )
    return out.select("id", attempts.alias("attempts"), F.coalesce("cost_cents", F.lit(0)).cast("long").alias("cost_cents"), outcome.alias("outcome"), "fields"), now
