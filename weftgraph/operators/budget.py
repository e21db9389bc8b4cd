"""Output budgets: ranked sections of lines cut to a number of tokens, for many tasks at once.

Lines go in a fixed order: first the last lines of the last sections, down to one more than each section keeps, then whole sections that may go, the last
first. A unit goes if what was left before it was still too much, so all of it is one running sum over each task's lines; nothing is decided line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Characters that a token takes, and tokens that every task has.
PER_TOKEN, LEAST = 3.5, 200


def trim(lines: DataFrame, budgets: DataFrame) -> DataFrame:
    """(task, section, place, line, trimmed): the lines that stay, and whether any of their task went.

    `lines` are (task, section, place, line, keep, may_go): sections are numbered in their order, places within them; `keep` and `may_go` are the section's.
    `budgets` are (task, tokens). Lines count with a break between each two; a task without a budget keeps all. Sections without lines don't count.
    """
    rows = lines.join(budgets.select("task", "tokens"), "task", "left")
    rank = F.row_number().over(Window.partitionBy("task", "section").orderBy("place"))
    rows = rows.withColumn("_n", rank)
    first = F.col("_n") > F.col("keep") + 1  # these go one by one
    rows = rows.withColumn("_phase", F.when(first, 0).when(F.col("may_go"), 1).otherwise(2)).withColumn("_size", F.length("line") + 1)
    rows = rows.withColumn("_line", F.when(F.col("_phase") == 0, F.col("_n")).otherwise(0))  # the lines of a section that goes whole are one unit
    own = F.sum("_size").over(Window.partitionBy("task", "_phase", "section", "_line"))
    total = F.sum("_size").over(Window.partitionBy("task"))
    through = F.sum("_size").over(Window.partitionBy("task").orderBy("_phase", F.desc("section"), F.desc("_line")))  # with its peers, in the order in which units go
    left = total - (through - own) - 1  # before this unit goes
    over = F.ceil(left / PER_TOKEN) > F.greatest(F.lit(LEAST), F.col("tokens"))
    gone = (F.col("_phase") < 2) & F.col("tokens").isNotNull() & over
    marked = rows.withColumn("_gone", gone)
    marked = marked.withColumn("trimmed", F.max("_gone").over(Window.partitionBy("task")))
    return marked.where("NOT _gone").select("task", "section", "place", "line", "trimmed")
