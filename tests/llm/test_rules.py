import re
from collections import Counter, defaultdict

from bibliospark.llm.common import WORD
from bibliospark.llm.rules import cleaned, judged

WHITE = " \t\n\x0b\f\r"


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub(r"[0-9]", "0", line.strip(WHITE).lower()))


def brute(rows, most_docs, most_share, least_kept):
    hosts, held = defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        if text is not None:
            hosts[source].add(text)
            for line in text.split("\n"):
                if WORD.search(line):
                    held[source, normal(line)].add(text)
    gone = {k for k, texts in held.items() if len(texts) > most_docs and len(texts) > most_share * len(hosts[k[0]])}
    out = []
    for i, text, source in rows:
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        triples = Counter(zip(words, words[1:], words[2:]))
        covered = {p for a in range(len(words) - 2) if triples[tuple(words[a : a + 3])] > 1 for p in (a, a + 1, a + 2)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        left = len(words) - sum(len(WORD.findall(x)) for x in lines if (source, normal(x)) in gone)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, left,
                    not failed and left >= least_kept * len(words)))
    return Counter(out), gone


def fixture(spark, small, small_rows):
    line = "Home | About us | Page 12 of 40"
    more = [(50_000 + i, f"{line}\n" + "\n".join(f"word{i} text{i * j} and so{j} it goes on for a while {j}" for j in range(3 + i % 9)) + f"\nHOME |  about us | page 7{i % 10} of 40 ", "hostA") for i in range(40)]
    more += [(60_000 + i, "\n".join([f"{line} {j}" for j in range(12)] + [f"own{i} line"]), "hostA") for i in range(30)]
    more += [(70_000 + i, more[0][1], "hostB") for i in range(30)] + [(80_000, "a b c " * 30, "hostB"), (80_001, "x\nx\nx \n\n y", None)]
    docs = small.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
    return docs, [*small_rows, *more]


def test_against_brute_force(spark, small, small_rows, nothing):
    docs, rows = fixture(spark, small, small_rows)
    want, gone = brute(rows, 20, 0.02, 0.3)
    got = Counter(tuple(r) for r in judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept").collect())
    assert got == want and gone
    assert sum(not r[-1] and not r[6] for r in got) >= 15
    texts = cleaned(docs).collect()
    assert len(texts) == sum(n for r, n in got.items() if r[-1])
    sources = {(i, t): s for i, t, s in rows}
    assert all(len(WORD.findall(r.text)) for r in texts) and sources
    assert judged(nothing).count() == 0


def test_a_line_in_one_percent_of_a_hot_host(spark):
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rare = spark.range(99_000).selectExpr("id AS doc_id", "concat('a', id, ' b', id, ' c', id) AS text", "'hot' AS source")
    held = spark.range(99_000, 100_000).selectExpr("id AS doc_id", f"concat('{long}', '\n', 'see also below', '\n', 'own', id, ' text', id) AS text", "'hot' AS source")
    got = judged(rare.unionByName(held)).filter("doc_id >= 99000").select("n_words", "base_failed", "n_left", "kept").distinct().collect()
    assert [tuple(r) for r in got] == [(65, False, 5, False)]
