"""Lines of letters beyond ASCII are no noise: a title may be written in them, and the authors stand below it."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import metadata


@pytest.mark.parametrize("title", ["Èê Èê Èê Èê", "Ö Ö Ö Ö Ö", "检索 增强 生成 的 方法"])
def test_titles_beyond_ascii(spark, title):
    page = f"12 - 14\n{title}\nWenyu Tao1, Xiaofen Xing2 and Ann B. Lee*\nAbstract\nthe text"
    found = metadata.detected_title(F.col("page"))
    got = spark.createDataFrame([(page,)], "page string").select(found.alias("t"), metadata.detected_authors(F.col("page"), F.coalesce(found, F.lit(""))).alias("a")).first()
    assert got.t == title and got.a == ["Wenyu Tao", "Xiaofen Xing", "Ann B. Lee"]


def test_lines_without_letters_are_noise(spark):
    rows = spark.createDataFrame([("12 - 14",), ("١٢ — ١٤",), ("***",), ("É",)], "line string")
    assert [r[0] for r in rows.select(metadata.title_noise(F.col("line"))).collect()] == [True, True, True, False]
