"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or data Spark derives from them) in full;
column names match the SQL oracle in ``linesift.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesift.operators import history, output, presets, prune
from linesift.operators.grep import compile_search, search_corpus
from linesift.plans import params as P
from linesift.sources.presets import presets_frame
from linesift.sources.tables import (
    CORPORA,
    corpus_segments,
    documents_corpus,
    documents_tree,
    pages_corpus,
    read_table,
)

HIT_VIEW = ("file_path", "line_number", "line_content")


def _doc_hits(spark, sf, needle, **opts) -> DataFrame:
    return search_corpus(documents_corpus(spark, sf), needle, **opts)


def q_scan_lines(spark, sf):
    return corpus_segments(documents_corpus(spark, sf)).select("file_path", "line_number", "raw")


def q_grep_literal(spark, sf):
    return _doc_hits(spark, sf, P.NEEDLE).select(*HIT_VIEW)


def q_grep_empty(spark, sf):
    return _doc_hits(spark, sf, "").select(*HIT_VIEW)


def q_grep_literal_ci(spark, sf):
    return _doc_hits(spark, sf, P.NEEDLE_CI, ignore_case=True).select(*HIT_VIEW)


def q_grep_regex(spark, sf):
    return _doc_hits(spark, sf, P.REGEX, regex=True).select(*HIT_VIEW)


def q_grep_regex_ci(spark, sf):
    return _doc_hits(spark, sf, P.REGEX_CI, regex=True, ignore_case=True).select(*HIT_VIEW)


def q_grep_word(spark, sf):
    return _doc_hits(spark, sf, P.NEEDLE, whole_word=True).select(*HIT_VIEW)


def q_grep_word_ci(spark, sf):
    return _doc_hits(spark, sf, P.NEEDLE_CI, ignore_case=True, whole_word=True).select(*HIT_VIEW)


def q_grep_word_regex(spark, sf):
    return _doc_hits(spark, sf, P.WORD_REGEX, regex=True, whole_word=True).select(*HIT_VIEW)


def q_grep_trailing_space(spark, sf):
    segs = corpus_segments(documents_corpus(spark, sf))
    return presets.grep_preset(segs, "Trailing Space").select(*HIT_VIEW)


def q_grep_rstrip(spark, sf):
    return search_corpus(CORPORA["conversations"](spark, sf), P.RSTRIP_NEEDLE).select(*HIT_VIEW)


def q_grep_preset_ipv4(spark, sf):
    segs = corpus_segments(documents_corpus(spark, sf))
    return presets.grep_preset(segs, "IPv4 Address").select(*HIT_VIEW)


def q_grep_preset_email(spark, sf):
    segs = corpus_segments(documents_corpus(spark, sf))
    return presets.grep_preset(segs, "Email Address").select(*HIT_VIEW)


def all_corpora_segments(spark, sf) -> DataFrame:
    parts = [corpus_segments(make(spark, sf).withColumn("corpus", F.lit(name)), keep=("corpus",)) for name, make in CORPORA.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_preset_scan(spark, sf):
    scan = presets.preset_scan(all_corpora_segments(spark, sf), keep=("corpus",))
    return scan.select("corpus", "file_path", "line_number", "category", "label")


def q_preset_scan_join(spark, sf):
    scan = presets.preset_scan_table(all_corpora_segments(spark, sf), presets_frame(spark), keep=("corpus",))
    return scan.select("corpus", "file_path", "line_number", "category", "label")


def q_pattern_index_scan(spark, sf):
    """Hits of patterns held in a table: the long words of ``benchmark``, whole ones by a regex, or as a literal behind a blank."""
    words = read_table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"), 1)).alias("label")).distinct()
    is_regex = F.length("label") % 2 == 1
    pattern = F.when(is_regex, F.concat(F.lit(r"\b"), "label", F.lit(r"\b"))).otherwise(F.concat(F.lit(" "), "label"))
    patterns = words.select(F.lit("words").alias("category"), F.lit(0).alias("ord"), "label", pattern.alias("pattern"), is_regex.alias("is_regex"))
    scan = presets.preset_scan_table(corpus_segments(documents_corpus(spark, sf)), patterns)
    return scan.groupBy("label").agg(F.count(F.lit(1)).alias("hits"))


def q_preset_counts(spark, sf):
    scan = presets.preset_scan(all_corpora_segments(spark, sf), keep=("corpus",))
    return presets.preset_counts(scan, presets_frame(spark))


def _word_ci_hits(spark, sf) -> DataFrame:
    return _doc_hits(spark, sf, P.NEEDLE_CI, ignore_case=True, whole_word=True)


def q_hit_count(spark, sf):
    return output.hit_count(_word_ci_hits(spark, sf))


def q_hits_per_file(spark, sf):
    search = compile_search(P.NEEDLE_CI, ignore_case=True, whole_word=True)
    return output.corpus_hits_per_file(documents_corpus(spark, sf), search)


def q_display_rows(spark, sf):
    return output.display_rows(_word_ci_hits(spark, sf))


def q_display_truncate(spark, sf):
    return output.display_truncate(_word_ci_hits(spark, sf))


def q_files_with_hits(spark, sf):
    return output.corpus_files_with_hits(documents_corpus(spark, sf), compile_search(P.REGEX, regex=True))


def q_files_without_hits(spark, sf):
    return output.corpus_files_without_hits(documents_corpus(spark, sf), compile_search(P.REGEX, regex=True))


def q_first_n_hits(spark, sf):
    return output.first_n_hits(_word_ci_hits(spark, sf), P.FIRST_N).select(*HIT_VIEW)


def q_scan_summary(spark, sf):
    return output.corpus_summary(documents_corpus(spark, sf), compile_search(P.REGEX, regex=True))


def tree_files(spark, sf) -> DataFrame:
    """The documents tree plus the page URLs as paths, with base name, extension and directories."""
    files = documents_tree(spark, sf, P.TREE_NAMES).select("file_path").unionByName(
        pages_corpus(spark, sf).select("file_path")
    )
    return prune.with_path_parts(files)


def q_split_path(spark, sf):
    return tree_files(spark, sf).select(
        "file_path", "base_name", "ext", F.array_join("dirs", "/").alias("dirs"), F.size("dirs").alias("n_dirs")
    )


def q_exclude_dirs(spark, sf):
    return prune.prune(tree_files(spark, sf), prune.Exclusions.of(dirs=P.EXCLUDE_DIRS)).select("file_path")


def q_exclude_exts(spark, sf):
    return prune.prune(tree_files(spark, sf), prune.Exclusions.of(exts=P.EXCLUDE_EXTS)).select("file_path")


def q_exclude_globs(spark, sf):
    return prune.prune(tree_files(spark, sf), prune.Exclusions.of(globs=P.EXCLUDE_GLOBS)).select("file_path")


def q_exclude_combined(spark, sf):
    defaults = prune.Exclusions.of(dirs=P.COMBINED_DEFAULT_DIRS, exts=P.COMBINED_DEFAULT_EXTS)
    ex = defaults.effective(dirs=P.COMBINED_CALL_DIRS, exts=None, globs=P.COMBINED_CALL_GLOBS)
    return prune.prune(tree_files(spark, sf), ex).select("file_path")


def q_exclude_ext_groups(spark, sf):
    exts = prune.toggle_groups(P.GROUPS_CURRENT, P.GROUPS_TICKED, P.GROUPS_UNTICKED)
    table = spark.createDataFrame([(e,) for e in exts], "ext string")
    return prune.prune_by_table(tree_files(spark, sf), table).select("file_path")


def q_exclude_union(spark, sf):
    config = prune.Exclusions.of(dirs=P.UNION_CONFIG_DIRS, exts=P.UNION_CONFIG_EXTS)
    ex = config.union(dirs=prune.split_comma_list(P.UNION_CLI_DIRS), exts=prune.split_comma_list(P.UNION_CLI_EXTS))
    return prune.prune(tree_files(spark, sf), ex).select("file_path")


def q_history_recent(spark, sf):
    events = read_table(spark, sf, "events")
    top = history.recent(events, ["user_id", "event_type"], ["ts", "event_id"], ["value"])
    return top.select(
        "user_id", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
