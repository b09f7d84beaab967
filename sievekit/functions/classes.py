"""Class codes and names of the labelled payload table."""

# ---------------------------------------------------------------------------
# Class codes and names of the labelled table
# (code map of the batch/CLI path: 1 XSS, 2 SQLi, 3 Normal; the demo path
# uses 0 Normal, 1 XSS, 2 SQLi).
# ---------------------------------------------------------------------------
BASE_CLASS_MAP = {1: "XSS", 2: "SQLi", 3: "Normal"}
BASE_CLASS_ORDER = ("XSS", "SQLi", "Normal")
DEMO_CLASS_ORDER = ("Normal", "XSS", "SQLi")
DEMO_CLASS_MAP = {0: "Normal", 1: "XSS", 2: "SQLi"}
# ---------------------------------------------------------------------------
