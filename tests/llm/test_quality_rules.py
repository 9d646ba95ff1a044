import re
from collections import Counter

from cases import ROWS, frame, key

from marketlens.llm import quality_rules

SMALL = "/root/testdata/sf0.001"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
            n < 20 or 100 * len(repeated) > 30 * n)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_figures_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(200)
    for df in (docs, frame(spark).select("doc_id", "text")):
        got = quality_rules.quality_rules(df).select("doc_id", *BASE).collect()
        assert sorted(map(tuple, got), key=key) == sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=key)


def test_awkward_rows(spark):
    got = quality_rules.quality_rules(frame(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert isinstance(r.kept, bool) and r.n_lost_words <= r.n_words and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


def verdict(spark, text):
    return quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


PROSE = "The committee met on Tuesday and agreed on the budget for the coming year, after a long debate about roads."
OTHER = "Most of the money goes to schools, and what is left will pay for two new bridges over the river"


def test_lines_fail_one_by_one(spark):
    r = verdict(spark, f"Home | News | Contact | About\n{PROSE}\nWe use cookies.\nRead on\n{OTHER}!")
    assert (r.n_navigation_lines, r.n_boilerplate_lines, r.n_lines) == (1, 1, 5)
    assert r.n_unended_lines == 2  # the menu, and a line of two words
    assert r.kept and r.clean_text == f"{PROSE}\n{OTHER}!"


def test_a_document_that_loses_too_much_goes(spark):
    junk = " | ".join(f"entry{i}" for i in range(40))
    assert not verdict(spark, f"{PROSE}\n{junk}").kept
    noise = " ".join(f"word{i}$$$" for i in range(40))
    assert not verdict(spark, f"{PROSE}\n{noise}").kept
    assert verdict(spark, f"{PROSE}\n{OTHER}, we read.").kept


def test_verdicts_follow_the_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id")
    rows = got.select("quality", "base_failed", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_menus_paths_and_notices_fail(spark):
    lines = ["Home, Products, About us, Contact, Log out now", "Home / Products / Shoes / Men / Running / Sale!",
             "We use cookies to give you the best service; by going on you accept our cookie policy and our privacy policy here.",
             "She said that he (or so they thought) had gone.\"))))))))"]
    r = verdict(spark, "\n".join([PROSE, OTHER + ".", *lines]))
    assert (r.n_navigation_lines, r.n_boilerplate_lines, r.n_unended_lines) == (2, 1, 1)
    assert r.clean_text == "\n".join([PROSE, OTHER + ".", lines[3]])
    assert verdict(spark, f"{PROSE}\n{OTHER}, for one thing, one, two, and three.").n_navigation_lines == 0
