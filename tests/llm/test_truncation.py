import json
import random

from quorix.llm import truncation as T

SCHEMA = "doc_id bigint, text string, source string, fmt string, evidence string, chars int"
WORDS = "sensor river window margin season panel".split()


def sentence(rng):
    a, b = rng.choice(WORDS), rng.choice(WORDS)
    return rng.choice([f"We count the final {a} before we rescale the {b}.", f"The {a} looks simple, so the {b} stays in the panel.", f"Run the next cell to plot the {a}, then merge what is left of the {b} by hand."])


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    docs, cut = [], set()
    for i in range(n):
        text = "\n\n".join(" ".join(sentence(rng) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(2, 9)))
        fmt, source = rng.choice(["md", "percent", "ipynb"]), "free"
        if fmt == "md" and rng.random() < 0.5:
            text += "\n\n```python\nx = load('a')\n```\n"
        if fmt == "ipynb":
            text = json.dumps({"cells": [{"source": text, "value": float("nan")}], "nbformat": 4})
        if i % 20 == 0:
            docs.append((i, text[: len(text) // 2], source, fmt))
            cut.add(i)
        elif i % 3 == 0 and fmt != "ipynb":
            docs.append((i, text[:500], "limited", fmt))
            if len(text) > 500:
                cut.add(i)
        else:
            docs.append((i, text.rstrip() if rng.random() < 0.5 else text + "\n", source, fmt))
    return docs, cut


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r.doc_id: r for r in T.detect_truncated(df).collect()}


def test_planted_cuts_are_found(spark):
    docs, cut = corpus()
    got = run(spark, docs)
    found = {i for i, r in got.items() if r.truncated}
    assert len(got) == len(docs)
    assert len(found & cut) >= 0.85 * len(cut)
    assert len(found - cut) <= 0.03 * len(docs)
    by = [got[i].evidence for i in found]
    assert {"limit", "trigram"} <= set(by)
    # the trigram decides first, also about JSON texts
    assert "trigram" in {got[i].evidence for i in found if docs[i][3] == "ipynb"}


def test_whole_texts_end_only_once(spark):
    """In JSON a line's end is no end: the same words are complete at the end of a text and cut inside it."""
    whole = json.dumps({"cells": [{"source": "we count rows"}, {"source": "we plot rows"}], "nbformat": 4}, indent=1)
    inner = whole[: whole.index("we plot")]
    rows = [(i, whole, "s", "ipynb") for i in range(40)] + [(40 + i, inner.rstrip()[: -i or None], "s", "ipynb") for i in range(9)]
    got = run(spark, rows)
    assert [got[i].truncated for i in range(40)] == [False] * 40
    assert [got[40 + i].truncated for i in range(9)] == [True] * 9
    assert sum(got[40 + i].evidence == "trigram" for i in range(9)) >= 5


def test_defined_cases(spark):
    rows = [
        (1, None, "s", "md"),
        (2, "", "s", "md"),
        (3, " \n\t ", None, None),
        (4, '{"a": 1}\n', "s", "ipynb"),
        (5, '{"a": 1', "s", "ipynb"),
        (6, '{"a": NaN}', "s", "ipynb"),
        (7, "```\nopen", "s", "md"),
        (8, "```\nclosed\n```", "s", "md"),
        (9, "short", None, None),
        (None, "short.", "s", "percent"),
        (4, '{"a": 1}\n', "s", "ipynb"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.evidence) for r in T.detect_truncated(df).collect()), key=str)
    want = {5: "json", 7: "fence"}
    assert got == sorted(((r[0], want.get(r[0])) for r in rows), key=str)


def test_rates_and_empty(spark):
    df = spark.createDataFrame([(1, '{"a', "s", "ipynb", "", 1), (2, "Fine.", "s", "md", "", 1), (3, "Fine.", None, "md", "", 1)], SCHEMA)
    rates = {r.source: (r.n_docs, r.n_truncated, r.rate) for r in T.truncation_rates(T.detect_truncated(df)).collect()}
    assert rates == {"s": (2, 1, 0.5), None: (1, 0, 0.0)}
    assert T.detect_truncated(df.limit(0)).count() == 0


def test_very_long_line(spark):
    rows = [(1, "A" * 2_000_000 + " end of it", "s", "percent"), (2, "B" * 3_000_000, "s", "percent")]
    assert len(run(spark, rows)) == 2


def test_cut_markers_outputs_and_statements(spark):
    body = "# %% [markdown]\n# - merge window\n# - check margin\n# ## season torven\n# %% In [1]\nout <- read_table(river)\n# Out [1]\n# File /opt/lib/core.py\n# KeyError: 'mimi'\n"
    whole = [(i, body, "s", "percent") for i in range(40)] + [(i, "- merge window\n\nThe panel is done.\n", "s", "md") for i in range(40, 60)]
    cuts = {100 + i: body[: body.index(at) + len(at)] for i, at in enumerate(["# %% [mark", "# Out [", "# File /opt/li", "out <-", "# - merge win"])}
    ends = {200 + i: body[: body.index(at) + len(at)] for i, at in enumerate(["# - check margin", "# ## season torven", "# KeyError: 'mimi'", "core.py"])}
    got = run(spark, whole + [(i, f"{t}", "s", "percent") for i, t in {**cuts, **ends}.items()])
    assert {i for i, r in got.items() if r.truncated} == set(cuts)
