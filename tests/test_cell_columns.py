"""Cells as columns give what cells in an array give, without lambdas over all fields."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docledger.operators import cell_columns, confidence, repair
from docledger.operators import cells as cl
from docledger.queries import QUERIES
from docledger.sources.specs import DocSpec, Field

ODD = [None, "", "  ", " x\t", "₹1,234.50", "n/a", "31/02/2020", "27/06/26", " 2020-01-31 ", "5 June 2021", "-", "0", "12345", "27aaaaa1234a1z5", "²/06/2020"]
DEFAULTS = {"text": " d ", "number": 0, "date": None, "": True, "long_text": ""}


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_columns_and_arrays_agree(spark):
    fields = tuple(Field(f"a.{k or 'none'}{n}", f"L {k}{n}", k) for k in DEFAULTS for n in (1, 2))
    spec = DocSpec("x", "X", fields=fields, skeleton={f.path: DEFAULTS[f.kind] for f in fields})
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id INT, x STRING")
    values = {f.path: (F.col("x"), "string") for f in fields if f.path.endswith("1")}
    values["a.number1"] = (F.col("x").try_cast("double"), "number")
    values["a.number2"] = (F.col("x"), "string")
    cells = cell_columns.header(spec, values)
    for mend in (False, True):
        array = rows.select("doc_id", cl.header_from_columns(spec, values).alias("c"))
        fixed = repair.repair(F.col("c")) if mend else F.transform("c", lambda c: c.withField("old", F.lit(None).cast("string")))
        array = array.select("doc_id", fixed.alias("c"))
        want = array.select("doc_id", F.arrays_zip("c", confidence.score(F.col("c")).alias("s")).alias("z"), repair.notes(F.col("c"), spec).alias("n"))
        want = {r.doc_id: ([(z.c.v, z.c.t, z.c.given, z.c.old, z.s.score) for z in r.z], r.n) for r in want.collect()}
        got = cells.read(rows, "doc_id", repair=mend)
        one = [cells.at(f.path) for f in spec.header_fields()]
        got = got.select("doc_id", F.array(*[F.struct(*[x.alias(n) for x, n in zip((c.v, c.t, c.given, c.old, c.score), "vtgos")]) for c in one]).alias("z"), cells.notes().alias("n"), cells.n_fixes().alias("k"))
        for r in got.collect():
            assert ([tuple(z) for z in r.z], r.n) == want[r.doc_id]
            assert r.k == len(r.n)


@pytest.mark.parametrize("name", ["heuristic_scores", "confidence_scores", "readiness", "auto_fix_notes", "finalize_documents"])
def test_cells_of_tables_are_not_gone_through_by_lambdas(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "zip_with(" not in plan
