"""Plan shape: pushdown, pruning, no needless shuffles (what must hold at scale)."""

import __spark_entry__ as E
from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_literal_search_pushes_filter_and_prunes_columns(spark):
    p = plan(E.queries()["grep_literal"](spark, SF_SMALL))
    assert "StringContains(text,the)" in p
    read = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "n_chars" not in read  # only the columns the query needs


def test_office_assembly_reuses_token_partitioning(spark):
    """Planned as at scale (no broadcast): joins, aggregates and windows reuse the staged partitioning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("xlsx_cells", "xlsx_shared_join", "pptx_paragraphs", "xlsx_sheet_summary", "scan_mixed"):
            p = plan(E.queries()[name](spark, SF_SMALL))
            assert "Exchange hashpartitioning" not in p, name
        # one branch, unstaged: the repartition by path is the only shuffle; aggregate and window reuse it
        p = plan(E.queries()["docx_paragraphs"](spark, SF_SMALL))
        assert p.count("Exchange hashpartitioning") == 1, p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_cross_or_nested_loop_joins(spark):
    for name, fn in E.queries().items():
        if name in ("detect_encoding", "decode_lines", "files_list"):
            continue
        p = plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, name


def test_per_file_results_need_no_shuffle(spark):
    """A file is one row: per-file counts and -l/-L are computed in the row (no join, no hash shuffle)."""
    for name in ("hits_per_file", "files_with_hits", "files_without_hits", "scan_summary"):
        p = plan(E.queries()[name](spark, SF_SMALL))
        assert "Exchange hashpartitioning" not in p and "Join" not in p, name


def test_general_counts_aggregate_before_shuffle(spark):
    from linesift.operators import output
    from linesift.operators.grep import search_corpus
    from linesift.sources.tables import documents_corpus

    hits = search_corpus(documents_corpus(spark, SF_SMALL), "the")
    assert plan(output.hits_per_file(hits)).count("HashAggregate") >= 2  # partial + final


def test_decode_has_no_join(spark):
    p = plan(E.queries()["decode_lines"](spark, SF_SMALL))
    assert "Join" not in p


def test_spreading_is_size_checked(spark):
    from linesift.session import balanced

    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert "RoundRobinPartitioning" in plan(balanced(df))  # small single-split input: spread
    assert "RoundRobinPartitioning" not in plan(balanced(df, max_bytes=0))  # above the size limit: untouched


def test_token_partitions_follow_the_input(spark):
    from linesift.operators import office
    from linesift.sources.office_writer import docx_bytes

    rows = [(f"f{i}.docx", bytearray(docx_bytes(f"line {i}", "s", "l"))) for i in range(40)]
    packages = spark.createDataFrame(rows, "path string, content binary").repartition(24)
    toks = office.tokenize(packages)
    assert toks.rdd.getNumPartitions() >= 24
