"""Questions to the data that decide whether an expression can be answered with a true number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions.values import DECIMAL
from ..plans.compiler import Compiler
from ..plans.syntax import Binary, Path, parse, spell_path, walk
from ..sources.records import Records


def operands(source: str) -> tuple[set[tuple], set[tuple]]:
    """The fields that an expression computes with or orders, and those that == and != compare."""
    numeric, compared = set(), set()
    for node in walk(parse(source)):
        if isinstance(node, Binary) and node.op not in ("and", "or"):
            into = compared if node.op in ("==", "!=") else numeric
            into |= {x.steps for x in (node.left, node.right) if isinstance(x, Path)}
    return numeric, compared


def probe(records: Records, source: str) -> DataFrame:
    """probe, field, key: the first record (by key) that an expression can't read truly, for each field and reason.

    range: a number no double reaches; nested: == meets a list or group; held: a number that is no double's shortest text.
    One pass over the records, before any filter.
    """
    numeric, compared = operands(source)
    compiler, tests = Compiler(records), []
    for steps in sorted(numeric | compared, key=str):
        v = compiler.value(Path(steps))
        if steps in numeric:
            tests.append(("range", steps, F.abs(v.num) == float("inf")))
            if v.kind == "json":
                tests.append(("held", steps, (v.tag == "num") & F.coalesce(v.held != v.num.try_cast(DECIMAL), F.lit(True)) & (F.schema_of_variant(v.column) != "DOUBLE")))
        if steps in compared and v.kind == "json":
            tests.append(("nested", steps, v.tag.isin("arr", "obj")))
    if not tests:
        return records.frame.sparkSession.createDataFrame([], "probe string, field string, key string")
    firsts = records.frame.agg(*(F.min(F.when(test, F.col("key"))).alias(f"p{i}") for i, (_, _, test) in enumerate(tests)))
    rows = F.array(*(F.struct(F.lit(name).alias("probe"), F.lit(spell_path(steps)).alias("field"), F.col(f"p{i}").alias("key")) for i, (name, steps, _) in enumerate(tests)))
    return firsts.select(F.explode(rows).alias("r")).select("r.*").where("key is not null")


def refuse_unsafe(records: Records, source: str) -> None:
    """Raises what probe() finds first."""
    found = probe(records, source).orderBy("field", "probe").first()
    if found:
        raise Refusal(found["probe"], f"{found['field']} of record {found['key']} can't be read truly")
