"""The parser: work that is done once, in code that the JVM compiles."""

from pyspark.sql import functions as F

from logspark import fixed
from logspark.operators import parsing

JIT_BYTES = 8000  # the JVM interprets longer methods for ever


def longest_method(frame):
    stages = frame._jdf.queryExecution().debug().codegenToSeq()
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def test_generated_parser_is_short_enough_to_be_compiled(spark, lines_of, tmp_path):
    lines = lines_of({1: ['{"level": "error", "message": "m", "ts": "2024-01-01T00:00:00Z"}'], 2: ["level=error msg=m ts=2024-01-01T00:00:00Z"]})
    lines.withColumn("format", F.when(F.col("file_id") == 1, "json").otherwise("logfmt")).write.parquet(str(tmp_path / "lines"))
    parsed = parsing.parse_lines(spark.read.parquet(str(tmp_path / "lines")), 2024)
    assert longest_method(parsed) < JIT_BYTES
    rows = sorted((r["file_id"], r["level"], r["message"], str(r["ts"])) for r in parsed.collect())
    assert rows == [(1, "error", "m", rows[0][3]), (2, "error", "m", rows[0][3])] and rows[0][3] != "None"


def test_logfmt_pairs_come_from_one_pass_with_the_matches_of_the_fixed_pattern(spark):
    texts = [
        'a=1 b="x y" a=2', r'msg="say \"hi\" there" level=error', r'msg="open \" end', 'k="" =5 x==y y=a=b', 'msg="a\\', r'q="\\" z="\\\"" w=1',
        "m=\"two\nlines\" n=1", 'x="a"b="c"', "none here", "", 'é="ü ü" ts=é',
    ]
    rows = spark.createDataFrame([(x,) for x in texts], "line string")
    pattern = F.lit(fixed.LOGFMT_PAIR)
    expected = F.struct(F.reverse(F.regexp_extract_all("line", pattern, 1)).alias("keys"), F.reverse(F.regexp_extract_all("line", pattern, 2)).alias("vals"))
    found = rows.select("line", parsing._logfmt_pairs(F.col("line")).alias("found"), expected.alias("expected")).collect()
    assert all(r["found"] == r["expected"] for r in found)
    plan = rows.select(parsing._logfmt_pairs(F.col("line")).alias("found"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_a_long_quoted_value_is_parsed(spark):
    line = 'level=error msg="' + "x" * 200_000 + '"'
    found = spark.createDataFrame([(line,)], "line string").select(F.size(parsing._logfmt_pairs(F.col("line"))["keys"])).first()[0]
    assert found == 2
