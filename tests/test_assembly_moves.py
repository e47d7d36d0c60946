"""What assemblies move: texts no more often than they must."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from corpusloom.operators import corpus as C, records as O


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def typed(spark):
    rng = random.Random(23)
    kinds = {"heading": "1. Scope", "article": "Article {n}\n{t}", "continuation": "{t}", "repeal": "Articles {n} - {m} were repealed", "anomaly": "{t}"}
    rows = [("a", n // 6, n % 6, k, kinds[k].format(n=n, m=n + 1, t=rng.randbytes(4000).hex()), "") for n in range(600) for k in [rng.choice(list(kinds))]]
    return spark.createDataFrame(rows, "doc string, page int, row_index int, kind string, en_text string, ar_text string")


def test_assembly_stores_texts_once(spark):
    """Texts went through five stored tables."""
    rows, folder = typed(spark), Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    stored, before = rows.agg(F.sum(F.length("en_text"))).head()[0], held()
    C.assemble(rows)
    assert held() - before < 1.5 * stored


def test_spans_leave_texts_alone(spark):
    articles = C.assemble(typed(spark))[0].select("doc", F.array_join("heading_path", " > ").alias("path"), "article_number")
    assert "_text" not in plan(O.heading_spans(articles))


def test_repealed_runs_gather_no_texts_of_articles_in_force(spark):
    assert "collect_list" not in plan(C.merge_repealed(C.assemble(typed(spark))[0]))
