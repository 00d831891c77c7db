"""Line dedup against a plain version."""

from paperloom.llm.line_dedup import SPACE, dedup_lines

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10):
    key = lambda line: line.strip(SPACE).translate(FOLD)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(h := holders.get(key(x), ())) < 2 or min(h) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, h1 string, _n int")
    return sorted(((r.doc_id, r.text or "", r._n_lines, r._n_dropped) for r in dedup_lines(df, **options).collect()), key=str)


def test_against_plain(spark):
    shared, cyrillic = "A Shared Line of text", "ОБЩАЯ СТРОКА ТЕКСТА"
    rows = [
        (3, f"{shared}\nown line number three\n\n{shared}"), (1, f"\t {shared.lower()} \r\nshort"), (2, "short\n" + shared.upper()), (4, None), (5, ""), (6, "short"), (6, "short"),
        (7, f"{cyrillic}\nx"), (8, f"{cyrillic.lower()}\n{cyrillic}"), (9, "own line of nine\nown line of nine"), (9, "own line of nine"), (None, shared), (10, " " + shared), (11, "\n".join(f"line {k} of many lines" for k in range(20_000)) + "\n" + shared),
    ]
    assert run(spark, rows) == plain(rows)


def test_other_thresholds_and_empty(spark):
    rows = [(1, "one line of text"), (2, "one line of text"), (3, "one line of text"), (4, "two lines of text"), (5, "two lines of text")]
    assert [r[3] for r in sorted(run(spark, rows, min_docs=3))] == [0, 1, 1, 0, 0]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a line of some text", "k1"), (2, "a line of some text", "k2")], "doc_id long, text string, keeper string")
    assert sorted((r.doc_id, r.text, r.keeper) for r in dedup_lines(df).collect()) == [(1, "a line of some text", "k1"), (2, "", "k2")]


def test_a_line_of_a_third_of_all_documents(spark):
    rows = [(k, "a line that very many documents hold\nown line of document " + str(k // 2)) if k % 3 == 0 else (k, f"another line of document {k}") for k in range(3000)]
    assert run(spark, rows) == plain(rows)


def test_columns_of_the_operators_own_names(spark):
    text = "a line that two documents hold"
    df = spark.createDataFrame([(1, text, 7, 8, 9), (2, text, 7, 8, 9)], "doc_id long, text string, _h1 int, _H2 int, _drop_id int")
    assert sorted(map(tuple, dedup_lines(df, counts=None).collect())) == [(1, text, 7, 8, 9), (2, "", 7, 8, 9)]
