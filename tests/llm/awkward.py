"""Small tables with every awkward case, and plain reference versions of what the operators compute."""

from __future__ import annotations

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, id string, print string, size string, "
          "sha string, keep string, score string, label string, part string, node string, start string")
EXTRA = ("x",) * 10

LONG = "word " * 5000 + "Long" * 3000


def documents(spark, rows=None):
    """Rows of doc_id, text, lang, source; the other columns clash with names that operators use inside."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows], SCHEMA)


ROWS = [
    (1, "the cat sat on the mat with the hat", "en", "a"),
    (2, "the cat sat on the mat with the hat", "en", "b"),
    (3, "THE cat sat on\tthe mat with the hat", "en", "a"),
    (4, "der hund lief über die straße und bellte", "de", "b"),
    (5, None, "en", "a"),
    (6, "", None, None),
    (7, " \n\t ", "en", None),
    (8, LONG, "en", "a"),
    (9, LONG, "en", "c"),
    (10, "12 34 !!", "de", "c"),
    (10, "12 34 !!", "de", "c"),
    (None, "a text without an id and some words", "en", "a"),
    (None, None, None, None),
    (11, "one", "en", "a"),
    (12, "Ein Satz mit ümlaut über öl und äpfel", "de", "a"),
]


def components(nodes, linked):
    """Smallest node of each component, by plain search."""
    found = {}
    for node in sorted(nodes):
        if node in found:
            continue
        stack = [node]
        while stack:
            at = stack.pop()
            if at not in found:
                found[at] = node
                stack += [other for other in nodes if other not in found and linked(at, other)]
    return found
