"""Context assembly: classes, formatting and greedy packing within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.text import token_estimate

BUDGET = 3000
# The sections in their order, with headings, and the words that decide a class in order of precedence.
SECTIONS = (("fact", "## Faits"), ("decision", "## Décisions"), ("action", "## Actions"), ("meeting", "## Réunions"), ("risk", "## Risques"))
CLASS_WORDS = (("decision", "decision|décision"), ("action", "action"), ("risk", "risk|risque"), ("meeting", "meeting|reunion|réunion"))


def classify(edge_name: Column) -> Column:
    out = F
    for kind, pattern in CLASS_WORDS:
        out = out.when(F.lower(edge_name).rlike(pattern), kind)
    return out.otherwise("fact")


def entry_text(content: Column, source: Column, page: Column, valid_at: Column) -> Column:
    shown = F.when(page.isNotNull(), F.concat(source, F.lit(" (p."), page.cast("string"), F.lit(")"))).otherwise(source)
    meta = F.concat_ws(", ", F.when(valid_at != "", F.concat(F.lit("date: "), valid_at)), F.concat(F.lit("source: "), shown))
    return F.concat(F.lit("- "), content, F.lit("\n  _("), meta, F.lit(")_"))


def pack(items: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``item_id, context, used, included`` from ``item_id, question, class, rank, entry``.

    Sections come in their order. One is opened only while used + heading is
    below the budget, else packing ends; within one, entries are taken while
    used + heading + entry fits, and the next section follows. A heading is
    charged once, and only if an entry was taken. Questions without items
    (class null) keep their heading line.
    """
    order = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(SECTIONS) for x in (k, i)])
    heading = F.element_at(F.array(*[F.lit(h) for _, h in SECTIONS]), F.col("s") + 1)
    own = items.withColumn("s", F.try_element_at(order, F.col("class"))).withColumn("t", token_estimate(F.col("entry")))
    own = own.withColumn("h", F.when(F.col("s").isNotNull(), heading)).withColumn("ht", token_estimate(F.col("h")))
    grouped = own.groupBy("item_id", "question").agg(
        F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "rank", "t", "entry", "h", "ht")))).alias("xs"))  # a question's candidates: 8
    head = F.concat(F.lit("## Question\n"), F.col("question"))
    start = F.struct(token_estimate(head).alias("used"), head.alias("out"), F.lit(0).alias("n"), F.lit(-1).alias("s"), F.lit(False).alias("open"), F.lit(False).alias("full"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        new = x["s"] != a["s"]
        opened = ~new & a["open"]
        done = a["done"] | (new & (a["used"] + x["ht"] >= budget))
        full = F.when(new, False).otherwise(a["full"])
        # until the section ends its heading isn't in ``used`` by the rules; here it is charged with the first entry
        charge = F.when(opened, 0).otherwise(x["ht"])
        fits = ~done & ~full & (a["used"] + charge + x["t"] <= budget)
        text = F.when(opened, F.concat(a["out"], F.lit("\n"), x["entry"])).otherwise(F.concat(a["out"], F.lit("\n\n"), x["h"], F.lit("\n"), x["entry"]))
        return F.struct(
            F.when(fits, a["used"] + charge + x["t"]).otherwise(a["used"]).alias("used"), F.when(fits, text).otherwise(a["out"]).alias("out"),
            (a["n"] + F.when(fits, 1).otherwise(0)).alias("n"), x["s"].alias("s"), (opened | fits).alias("open"), (full | ~fits).alias("full"), done.alias("done"),
        )

    packed = F.aggregate("xs", start, step)
    return grouped.select("item_id", packed.alias("p")).select("item_id", F.col("p.out").alias("context"), F.col("p.used").alias("used"), F.col("p.n").alias("included"))
