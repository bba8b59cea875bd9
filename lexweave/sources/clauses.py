"""A second view of the relational tables as text: one template for every unit, marker, kind of definition and kind of citation, and texts with every kind of line.

Templates say what they hold, so SQL that knows the templates only can tell what operators that know the patterns only must find.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.bundle import dealt, saved


@dataclass(frozen=True)
class Clause:
    text: str
    unit: str | None = None
    marker: str | None = None
    defines: str | None = None
    """The surface that it defines."""
    kind: str | None = None
    cites: bool = False


CLAUSES = (
    Clause("Provided further that no price is set on part {p} here.", "proviso"),
    Clause("Explanation I. - the part {p} counts as goods of trade.", "explanation"),
    Clause("Illustration - the holder of part {p} sells it abroad.", "illustration"),
    Clause("Exception 2: the part {p} stays out of this count.", "exception"),
    Clause("(7) the part {p} is kept in good order by its holder.", "sub_section"),
    Clause("(b) the part {p} is kept in good order by its holder.", "clause"),
    Clause("SCHEDULE of parts and prices for part {p} in stock.", "schedule"),
    Clause("Notwithstanding anything contained in the rules on part {p} it stands.", None, "non_obstante"),
    Clause("The part {p} moves subject to the other provisions made for it.", None, "subject_to"),
    Clause("The part {p} stays save as otherwise provided by its owner.", None, "save_as_provided"),
    Clause("Nothing contained in rule {p} on parts shall apply to goods here.", None, "nothing_in_referenced_shall_apply", cites=True),
    Clause("Nothing in this section shall apply to the part {p} at sea.", None, "nothing_shall_apply"),
    Clause("Unless the context asks for more the part {p} is one of ours.", None, "unless"),
    Clause("The part {p} shall be deemed to be one of the goods sold.", None, "deeming"),
    Clause("The duty on sale shall not apply to part {p} of the stock.", None, "shall_not_apply_to"),
    Clause("For the purposes of this section the part {p} is one good.", None, "for_the_purposes_of"),
    Clause("For the purposes of section 4, the part {p} is one good.", None, "for_the_purposes_of_referenced", cites=True),
    Clause("In the list for the words old part, the words part {p} shall be substituted.", None, "substitution"),
    Clause("After the list the part {p} shall be inserted in its place.", None, "insertion"),
    Clause("The word for part {p} shall be omitted from the list.", None, "omission"),
    Clause("The old rules for part {p} are hereby repealed from now on.", None, "repeal"),
    Clause("The view on part {p} is overruled by what was said since.", None, "overruled"),
    Clause("The view on part {p} was taken per incuriam and is gone.", None, "per_incuriam"),
    Clause("The case of part {p} is distinguishable from the one at hand.", None, "distinguished"),
    Clause("The view on part {p} was affirmed in a later case of note.", None, "affirmed"),
    Clause("Notwithstanding the foregoing the part {p} is sold as it is.", None, "notwithstanding_clause"),
    Clause("The part {p} is sold except that its box is not for sale.", None, "except_that"),
    Clause("The part {p} is sold provided, however, that it is paid for.", None, "provided_however"),
    Clause("The duty on part {p} shall survive termination of the sale.", None, "survival"),
    Clause("The aggregate liability on part {p} is not to exceed its price.", None, "liability_cap"),
    Clause('The word "ware {p}" means goods of that part and no other.', defines="ware {p}", kind="means"),
    Clause('The word "kind {p}" includes goods of that part and more.', defines="kind {p}", kind="includes"),
    Clause('The word "box {p}" shall mean the case of that part alone.', defines="box {p}"),
    Clause('The holder of part {p} (hereinafter called "Holder {p}") is bound by it.', defines="Holder {p}"),
    Clause("(a) “good {p}” means all the goods of that part in stock.", "clause", defines="good {p}", kind="means"),
    Clause("The case AIR 1998 SC 12 speaks of part {p} and its sale.", cites=True),
    Clause("The Holders Act, 1999 speaks of part {p} and its sale at sea.", cites=True),
    Clause("Article 14 speaks of the holder of part {p} and its sale.", cites=True),
    # near misses
    Clause("The part {p} is subject to the weather and to no rule of ours.",),
    Clause("The holder of part {p} keeps a record of it in good order.",),
)

BASE = "b AS (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, min(l_partkey) AS p FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"


def _case(of, string: str) -> str:
    """A CASE over t of what of() gives for each clause."""
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return "CASE t " + " ".join(f"WHEN {i} THEN {quoted(of(c))}" for i, c in enumerate(CLAUSES)) + " END"


def nodes_sql(lineitem: str, string: str) -> str:
    return f"""{BASE.replace('{lineitem}', lineitem)},
k AS (SELECT ok, ln, p, (ok * 8 + ln) % {len(CLAUSES)} AS t FROM b),
c AS (SELECT 'c' || CAST((ok - ok % 1000) / 1000 AS BIGINT) AS doc_id, ok * 8 + ln AS seq, 'c:' || CAST(ok * 8 + ln AS {string}) AS node_id, ok, ln, p, t,
  replace({_case(lambda c: c.text, string)}, '{{p}}', CAST(p AS {string})) AS raw FROM k)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, doc_id, seq, kind, raw."""
    sql = "WITH " + nodes_sql("@lineitem", "STRING") + " SELECT doc_id, seq, node_id, 'proposition' AS kind, raw FROM c"
    sql = sql.replace("{", "{{").replace("}", "}}").replace("@lineitem", "{lineitem}")  # spark.sql() formats what is in braces
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    made = spark.sql(sql, lineitem=dealt(lines, "l_orderkey", "l_linenumber"))
    return saved(made, "clauses")


def oracle(rest: str) -> str:
    """SQL over x: the view with what each clause holds (unit, marker, surface, definition_kind, cites)."""
    surface = f"replace({_case(lambda c: c.defines, 'VARCHAR')}, '{{p}}', CAST(p AS VARCHAR))"
    cites = ", ".join(str(i) for i, c in enumerate(CLAUSES) if c.cites)
    return f"""WITH {nodes_sql('lineitem', 'VARCHAR')},
x AS MATERIALIZED (SELECT *, {_case(lambda c: c.unit, '')} AS unit, {_case(lambda c: c.marker, '')} AS marker, {surface} AS surface, {_case(lambda c: c.kind, '')} AS definition_kind, t IN ({cites}) AS cites FROM c){'' if rest.lstrip().startswith('SELECT') else ','}
{rest}"""


#: unit and its lines, in the order in which they stand in a text
LINES = (
    ("chapter", "CHAPTER IV"),
    ("heading", "Section 12. Stock of part {p}"),
    ("subsec", "(1) The part {p} is kept."),
    ("proviso", "Provided that the part {p} is paid."),
    ("explanation", "Explanation. The part {p} is one."),
    ("illustration", "Illustration: the part {p} is sold."),
    ("exception", "Exception 1. The part {p} is free."),
    ("clause", "(a) the part {p} in its box;"),
    ("clause_d", "b. the box of part {p}."),
    ("md_heading", "# Parts {p}"),
    ("heading", "13. Sale of part {p}:—"),
    ("subsec", "14. The part {p} shall be sold."),
    ("heading_bare", "15.\nSale at sea {p}"),
    ("footnote", "2. Ins. by Act 5 of 1990."),
    ("footnote?", "3. Old part {p}"),
    ("text", "Plain words on part {p}"),
    ("schedule", "THE FIRST SCHEDULE"),
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: a text with every kind of line for each order."""
    whole = "\n\n".join(line for _, line in LINES)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("p"))
    own = dealt(lines, "ok").groupBy("ok").agg(F.min("p").alias("p"))
    return own.select(F.concat(F.lit("t"), "ok").alias("doc_id"), F.replace(F.lit(whole), F.lit("{p}"), F.col("p").cast("string")).cast("binary").alias("content"))


def lines_oracle() -> str:
    rows = ", ".join(f"({i}, '{unit}', '{line}')" for i, (unit, line) in enumerate(LINES))
    return f"""WITH o AS (SELECT l_orderkey AS ok, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey), l(n, unit, line) AS (VALUES {rows})
SELECT 't' || CAST(ok AS VARCHAR) AS doc_id, CAST(n AS BIGINT) AS n, unit, replace(line, '{{p}}', CAST(p AS VARCHAR)) AS raw FROM o, l"""
