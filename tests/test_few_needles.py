"""A bounded number of passages is looked up in one scan of the texts; more of them are joined, with the same result."""

import random

from bibliospark.operators import blocking


def test_few_needles_meet_texts_where_they_are_read(spark, monkeypatch):
    rng = random.Random(5)
    letters = "abcdé𝔸 .\n"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.choice((0, 2, 40, 400))))) for i in range(120)] + [(120, None)]
    texts += [(121, "no one knows the whole passage here"), (122, "so the whole\npassage"), (123, "xthe whole passagey")]
    needles = [(i, t[a : a + rng.choice((1, 2, 3, 5, 12))]) for i, (_, t) in enumerate(rng.choices(texts[:120], k=80)) for a in [rng.randrange(300)]]
    needles += [(90, "the whole passage"), (91, "whole passage"), (92, "hol"), (93, "zzzz"), (94, ""), (95, None), (96, "whole")]
    want = sorted((i, j, t.find(n) + 1) for i, n in needles if n for j, t in texts if t and n in t)
    asked, held = spark.createDataFrame(needles, "needle_id int, needle string"), spark.createDataFrame(texts, "text_id long, text string")

    def found():
        rows = blocking.containment_join(asked, held, passages=True)
        return rows.schema.simpleString(), sorted(tuple(r) for r in rows.select("needle_id", "text_id", "position").collect())

    monkeypatch.setattr(blocking, "FEW", 0)
    joined = found()
    monkeypatch.undo()
    monkeypatch.setattr(blocking, "cut_lineage", None)  # no words of the texts are kept
    monkeypatch.setattr(blocking, "ROWS", 10)
    assert found() == joined == (joined[0], want) and len(want) > 200
    empty = blocking.containment_join(asked.filter("needle_id = 94"), held, passages=True)
    assert empty.collect() == []
