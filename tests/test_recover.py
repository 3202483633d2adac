"""Symbol recovery cases (table of FIXTURES §5) and the plan shape."""

from fleetlog.operators import recover
from fleetlog.sources import fixtures

CASES = [
    ("ProcessOrderBatchFro", "rder/Processing.cpp:100", "ProcessOrderBatchFromQueue", "app/src/order/Processing.cpp", 100),
    ("ProcessOrderBatchFro", "atch/Commit.cpp:106", "ProcessOrderBatchFro", "atch/Commit.cpp", 106),
    ("CommitBatch", "atch/Commit.cpp:103", "CommitBatch", "app/src/batch/Commit.cpp", 103),
    ("Commit", "atch/Commit.cpp:104", "CommitBatchCore", "app/src/batch/Commit.cpp", 104),
    ("ComputeTotals", "tils/Totals.h:104", "ComputeTotals", "app/src/other/Totals.cpp", 104),
    ("ComputeTotals()", "zz.cpp:9", "ComputeTotals", "app/src/other/Totals.cpp", 9),
    ("operator()", "a/Io.h:111", "operator()", "a/Io.h", 111),
    ("P", "Processing.cpp:250", "ProcessOrderBatchFromDisk", "app/src/order/Processing.cpp", 250),
    ("", "x.cpp:1", "", "x.cpp", 1),
]


def test_recovery_cases(spark):
    keys = spark.createDataFrame([(f, fl) for f, fl, *_ in CASES], "function string, fileline string")
    got = {(r["function"], r["fileline"]): (r["name"], r["path"], r["line"])
           for r in recover.resolve_keys(keys, fixtures.symbols(spark)).collect()}
    for f, fl, name, path, line in CASES:
        assert got[(f, fl)] == (name, path, line), (f, fl)


def test_prefix_join_is_hash_join(spark):
    keys = spark.createDataFrame([("Commit", "atch/Commit.cpp:104")], "function string, fileline string")
    plan = recover.resolve_keys(keys, fixtures.symbols(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan
    assert "HashJoin" in plan or "SortMergeJoin" in plan


def test_ctags_lines(spark):
    from fleetlog.sources import symbols
    lines = spark.createDataFrame([
        ("Foo function 12 src/a.cpp int Foo()",),
        ("operator = function 3 src/b.h T& operator=(const T&)",),
        ("one two three function 4 src/c.cpp void x()",),
        ("Bar function x12 src/d.cpp void Bar()",),
        ("no marker here at all",),
        ("Far function 12345678901 src/e.cpp void Far()",),
        ("Beyond function 123456789012345678901234567890 src/f.cpp void Beyond()",),
    ], "value string")
    got = [(r["name"], r["path"], r["line"]) for r in symbols.parse_ctags(lines).orderBy("seq").collect()]
    assert got == [("Foo", "src/a.cpp", 12), ("operator =", "src/b.h", 3), ("Far", "src/e.cpp", 12345678901)]


def _expected(function, fileline, symbols):
    """The rules of the module, key by key."""
    parts = fileline.split(":")
    path = parts[0] if len(parts) == 2 else fileline
    line = int(parts[1]) if len(parts) == 2 and parts[1].isdigit() else None
    found = [s for s in symbols if s[0].startswith(function.rstrip("()"))]
    if line is not None and len(found) > 1:
        found = sorted((s for s in found if s[1].endswith(path)), key=lambda s: (abs(s[2] - line), s[3]))
    if line is None or not found:
        return function, path, line
    return found[0][0], found[0][1], line


def test_nearest_lines_against_all_pairs(spark):
    symbols = [(f"Name{i % 5}{'ab'[i % 2]}", f"src/{i % 3}/File{i % 2}.cpp", (i * 7919) % 200_000, i) for i in range(120)]
    keys = [(f, f"{p}:{n}") for f in ("", "Name", "Name3", "Name3b", "Name3b()", "Nope")
            for p in ("", "cpp", "File1.cpp", "2/File1.cpp", "else.cpp") for n in ("0", "65536", "99999", "250000", "x")]
    got = recover.resolve_keys(spark.createDataFrame(keys, "function string, fileline string"),
                               spark.createDataFrame(symbols, "name string, path string, line int, seq int")).collect()
    assert len(got) == len(keys)
    for r in got:
        assert (r["name"], r["path"], r["line"]) == _expected(r["function"], r["fileline"], symbols), r


def test_keys_and_symbols_are_never_paired(spark):
    """The symbols of a prefix are summed up before they meet the keys."""
    n = 3000
    keys = spark.range(n).selectExpr("'Name' AS function", "concat('x.cpp:', id) AS fileline")
    symbols = spark.range(n).selectExpr("concat('Name', id) AS name", "'src/x.cpp' AS path", "int(id) AS line", "id AS seq")
    done = recover.resolve_keys(keys, symbols)
    assert done.where("name = concat('Name', line)").count() == n

    def rows(plan):
        """The greatest number of rows that a join of the plan gave."""
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return rows(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return rows(plan.plan())
        own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
        below = plan.children()
        return max([own, *[rows(below.apply(i)) for i in range(below.size())]])

    assert 0 < rows(_ran(done)) <= 20 * n


def _ran(df):
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    return execution.executedPlan()
