"""Operator 2 against counts in plain Python."""
import re
from collections import Counter

from .conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobscope.llm import line_rules
from jobscope.llm.queries import QUERIES


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_surface_counts(spark, docs):
    got = QUERIES["op2_line_rules"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        row = got.loc[i]
        assert tuple(row[COLUMNS]) == plain(t)
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
        assert not (row.base_failed and row.kept)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab c\n#é", max_size=60), min_size=1, max_size=8))
def test_surface_counts_of_any_text(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = table.select("i", line_rules.surface(F.col("text")).alias("s")) \
        .select("i", "s.w.n_words", "s.w.word_chars", "s.n_symbols", "s.n_dup_lines", "s.w.n_repeat_words").collect()
    assert {r.i: tuple(r)[1:] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def plain_verdicts(rows, max_docs):
    """(n_removed_words, kept) of rows (doc_id, text, source), in their order."""
    def lines(text):
        found = (" ".join(re.findall(r"[^\W\d_]+", x.lower())) for x in (text or "").split("\n"))
        return [x for x in found if x]
    holders = {}
    for k, (i, text, host) in enumerate(rows):
        for x in lines(text):
            holders.setdefault((host or "", x), set()).add(("row", k) if i is None else i)
    out = []
    for i, text, host in rows:
        n_words, *_, repeated = plain(text or "")
        removed = min(n_words, sum(len(x.split()) for x in lines(text) if len(holders[host or "", x]) > max_docs))
        left = n_words - removed
        failed = n_words < 50 or 100 * repeated > 50 * n_words
        out.append((removed, not failed and not (removed and (left < 0.4 * n_words or left < 30))))
    return out


def verdicts(spark, rows, max_docs):
    """The same by the operator; rows are told apart by their texts' ends."""
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return line_rules.line_verdicts(line_rules.counted(table), max_docs)


def sentence(k, n=60):
    letters = "abcdefghijklmnop"
    return f"own line {letters[k % 16]}{letters[k // 16]} " + " ".join(f"w{letters[k % 16]}{letters[k // 16]}{letters[j % 16]}{letters[j // 16]}" for j in range(n))


MENU = "Home | About | Contact us and read the terms"


def test_frequent_lines_go_from_every_document(spark):
    rows = [(i, f"{MENU}\n{sentence(i)}", "h") for i in range(8)] + [(20, f"{MENU}\n{sentence(0)}", "h"), (30, f"{MENU}\n{sentence(1)} else", "other")]
    table = line_rules.counted(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert [(r.host, r.n_docs) for r in line_rules.frequent_lines(table, max_docs=5).collect()] == [("h", 9)]
    got = line_rules.line_verdicts(table, max_docs=5)
    assert {r.doc_id: (r.n_removed_words, r.kept) for r in got.collect()} == dict(zip([r[0] for r in rows], plain_verdicts(rows, 5)))
    clean = line_rules.without_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), got).toPandas().set_index("doc_id").text
    assert clean[1] == sentence(1) and clean[0] == sentence(0) and clean[30].startswith(MENU)


def test_copies_are_documents(spark):
    """A hundred copies of one text: every line is frequent, and every copy is depleted."""
    text = "\n".join(sentence(k) for k in range(3))
    rows = [(i, text, "h") for i in range(100)] + [(1000, sentence(7), "h"), (1001, text, "elsewhere")]
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in verdicts(spark, rows, 20).collect()}
    assert got == dict(zip([r[0] for r in rows], plain_verdicts(rows, 20)))
    assert not got[5][1] and got[1000] == (0, True) and got[1001][1]


def test_repeated_rows_and_null_ids(spark):
    """A row that stands three times loses the words of its lines once, not three times; null ids are documents each."""
    menus = "\n".join(f"{MENU} {x}" for x in "abcd")
    rows = [(i, f"{menus}\n{sentence(i)}", "h") for i in range(6)] + [(3, f"{menus}\n{sentence(3)}", "h")] * 2
    rows += [(None, f"shared by rows without an id\n{sentence(40 + k)}", None) for k in range(7)] + [(3, f"{menus}\n{sentence(50)}", "h")]
    got = verdicts(spark, rows, 5)
    assert sorted((r.n_words, r.n_removed_words, r.kept) for r in got.collect()) == \
        sorted((plain(t)[0], *v) for (_, t, _), v in zip(rows, plain_verdicts(rows, 5)))
    assert got.where("NOT kept").count() == 0 and got.where("n_removed_words = 0").count() == 0


def test_depleted_documents_are_rejected(spark):
    shared = [" ".join(f"shared{a}{b}" for b in "abcdefghij") for a in "abcdefgh"]
    rows = [(i, "\n".join([*shared, f"own words {chr(97 + i)}"]), "h") for i in range(9)]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in verdicts(spark, rows, 5).collect()}
    assert kept == {i: (False, False) for i in range(9)}


def test_edge_cases(edge, empty):
    got = line_rules.line_verdicts(line_rules.counted(edge), max_docs=0).toPandas()
    assert len(got) == edge.count() and got[got.doc_id.isin([1, 2, 3])].n_words.eq(0).all()
    assert line_rules.line_verdicts(line_rules.counted(empty)).count() == 0
