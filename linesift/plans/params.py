"""Parameters of the registered queries, shared by the Spark plans and the SQL oracle."""

NEEDLE = "the"
NEEDLE_CI = "The"
REGEX = r"(ou|eau)x? [a-z]+tion"
REGEX_CI = r"MENT[A-Z]*[.,]"
WORD_REGEX = "the|and"
RSTRIP_NEEDLE = "."
FIRST_N = 100

# A file tree derived from `documents`: each source directory holds one kind of file name.
# (prefix, suffix) of the base name around the doc_id.
TREE_NAMES = {
    "src0": ("", ".txt"),
    "src1": ("", ".log"),
    "src2": ("", ".md"),
    "src3": ("", ".bak"),
    "src4": ("", ".TXT"),
    "src5": ("", ".png"),
    "src6": ("", ".tar.gz"),
    "src7": ("", ".tmp"),
    "src8": ("", ".csv"),
    "src9": ("", ".py"),
    "src10": ("", ".txt"),
    "src11": ("", ".json"),
    "src12": ("", ".gz"),
    "src13": (".", ".log"),
    "src14": ("", ".html"),
    "src15": ("", ".zip"),
    "src16": (".", ""),
    "src17": ("", "."),
    "src18": ("old.", ".txt"),
    "src19": ("", ".pyc"),
}

EXCLUDE_DIRS = ["src1", "fr", " ", "blog.ththan.example.net"]
EXCLUDE_EXTS = [".LOG", "md", " gz ", ""]
EXCLUDE_GLOBS = ["*.bak", "1??.*", "[0-4]*.t?t", "*.html", "old.*"]

COMBINED_DEFAULT_DIRS = ["src3"]
COMBINED_DEFAULT_EXTS = [".png"]
COMBINED_CALL_DIRS: list[str] = []  # replaces the default: nothing excluded by directory
COMBINED_CALL_GLOBS = ["*5.txt"]

GROUPS_CURRENT = ["TXT"]
GROUPS_TICKED = ["archives", "temp_logs", "images"]
GROUPS_UNTICKED = ["images"]

UNION_CONFIG_DIRS = ["src2"]
UNION_CONFIG_EXTS = [".log"]
UNION_CLI_DIRS = " src2 , src5,, en"
UNION_CLI_EXTS = "csv, .JSON"
