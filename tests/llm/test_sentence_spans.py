import random
import re

import numpy as np
import pytest

from foldspark.llm import sentence_spans as S
from foldspark.llm.shingles import span_hashes

from .conftest import prose


def breaks(word):
    raw = np.frombuffer(word, np.uint8)
    return bool(S.breaks_after(span_hashes(raw, np.array([0]), np.array([len(raw)])))[0])


def cut_words(text):
    """Sentences as (words, bytes), by a plain walk over the text."""
    data = (text or "").encode()
    parts, start = [], 0
    for m in re.finditer(rb"[.!?]+[ \t\n\x0b\x0c\r]+|\n[ \t\n\x0b\x0c\r]*", data):
        parts.append(data[start : m.end()])
        start = m.end()
    parts.append(data[start:])
    out, head = [], b""
    for part in parts:
        words = [(m.start(), m.group()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", part)]
        if not words:
            if out:
                out[-1] = (out[-1][0], out[-1][1] + part)
            else:
                head += part
            continue
        cuts, last = [0], 0
        for k in range(1, len(words)):
            if len(words) > 25 and breaks(words[k - 1][1]) or k - last == 25:
                cuts.append(k)
                last = k
        for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True):
            begin = 0 if a == 0 else words[a][0]
            end = words[b][0] if b < len(words) else len(part)
            out.append(([w for _, w in words[a:b]], (head if not out else b"") + part[begin:end]))
    return out


def brute(rows):
    """Each text without the sentences of runs that an earlier (doc_id, place) has had."""
    seen, later = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        sentences = cut_words(text)
        n, spans = len(sentences), set()
        size = [len(w) for w, _ in sentences]
        for a in range(n):
            for b in range(a + 2, n + 1):
                if sum(size[a:b]) >= 25:
                    spans.add((a, b))
                    break
        for b in range(n, 0, -1):
            for a in range(b - 2, -1, -1):
                if sum(size[a:b]) >= 25:
                    spans.add((a, b))
                    break
        for a, b in sorted(spans):
            words = tuple(w for ws, _ in sentences[a:b] for w in ws)
            if seen.setdefault(words, (i, text, a, b)) != (i, text, a, b):
                later.setdefault((i, text), set()).update(range(a, b))
    out = {}
    for i, text in rows:
        gone, sentences = later.get((i, text), set()), cut_words(text)
        out[(i, text)] = (text if not gone else b"".join(b for k, (_, b) in enumerate(sentences) if k not in gone).decode().rstrip(), len(sentences), len(gone))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    passages = [prose(50 + k, 60).rstrip(".") + "." for k in range(3)] + [" ".join(f"w{k}." for k in range(55)), " ".join(f"v{k}" for k in range(58)) + ".", "Oh! No! " * 30]
    rows = []
    for i in range(60):
        parts = [prose(1000 + i * 7 + k, rng.randrange(3, 60)) for k in range(3)]
        if i % 3:
            parts.insert(rng.randrange(4), passages[(i // 3) % len(passages)])
        rows.append((i, rng.choice(["\n", " . \n ", "\n\n"]).join(parts)))
    return rows + [(100, rows[4][1]), (101, rows[4][1] + " more."), (102, "Short. Text. Again."), (103, "Short. Text. Again.")]


def check(make, rows):
    wanted = brute(rows)
    found = S.without_repeats(make(rows)).select("doc_id", "text", "_spans.*", "n_chars", "key").collect()
    assert len(found) == len(rows)
    cut = {}
    texts = dict(rows)
    for r in found:
        cut[r["doc_id"]] = r["text"]
        if r["doc_id"] is not None:
            assert (r["text"], r["sentences"], r["removed"]) == wanted[(r["doc_id"], texts[r["doc_id"]])]
    return cut


def test_equals_brute_force(make, corpus):
    cut = check(make, corpus)
    assert cut[100] == "" and cut[4] != ""
    assert cut[102] == cut[103] == "Short. Text. Again."


def test_passages_go_from_all_but_the_first(make, corpus):
    cut = check(make, corpus)
    passages = [prose(50 + k, 60).rstrip(".") + "." for k in range(3)] + [" ".join(f"w{k}." for k in range(55)), " ".join(f"v{k}" for k in range(58)) + "."]
    for p in passages:
        holders = [i for i, t in corpus if p in t]
        assert len(holders) > 3
        sentences = [x for x in p.split(". ") if len(x.split()) > 2] or [p[:60]]
        for i in holders[1:]:
            assert not any(x in cut[i] for x in sentences), i
        assert p in cut[holders[0]] or all(x in cut[holders[0]] for x in sentences)


def test_passages_inside_other_sentences(make):
    """A passage that neither begins nor ends with a sentence: nothing of 50 words is left twice."""
    passage = [w.strip(".") for w in prose(77, 90).split()]
    rows = [(i, " ".join([*prose(800 + i, 30 + 7 * i).replace(".", "").split(), *passage, *prose(900 + i, 20).replace(".", "").split()])) for i in range(6)]
    cut = check(make, rows)
    assert " ".join(passage) in cut[0]
    for i in range(1, 6):
        assert not any(" ".join(passage[k : k + 50]) in cut[i] for k in range(40))
        assert cut[i].startswith(" ".join(rows[i][1].split()[:20]))


def test_passages_that_begin_inside_a_sentence(make):
    """55 words that begin inside a sentence of 20: the two whole sentences of 20 words in them go."""
    words = prose(78, 200).replace(".", "").split()
    passage = " ".join(words[:15]) + ". " + " ".join(words[15:35]) + ". " + " ".join(words[35:55]) + "."
    rows = [(i, " ".join(prose(820 + i, 20).replace(".", "").split()[:5]) + " " + passage + " " + prose(830 + i, 40)) for i in range(5)]
    cut = check(make, rows)
    assert passage in cut[0]
    for i in range(1, 5):
        assert " ".join(words[15:35]) not in cut[i] and " ".join(words[35:55]) not in cut[i]
        assert " ".join(words[:15]) in cut[i]


def test_clashing_names(spark):
    text = prose(9, 60)
    rows = [(i, text + f" Own{i} " + prose(20 + i, 40), 1, 2, "r", i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, b int, row string, places int")
    found = S.without_repeats(docs)
    assert found.columns == [*docs.columns, "_spans"] and found.filter("_spans.removed > 0").count() == 2
    with pytest.raises(ValueError, match="into"):
        S.without_repeats(found)
    assert S.without_repeats(found, into="again").filter("again.removed > 0").count() == 0


def test_edges(make, edge_rows):
    rows = [r[:2] for r in edge_rows]
    cut = check(make, rows)
    assert cut[2] is None and cut[3] == "" and cut[5] == "" and cut[1] == rows[0][1]
    assert S.without_repeats(make(edge_rows).limit(0)).count() == 0
    h, g, places = S.runs(rows[9][1])
    assert len(np.unique(h)) == len(np.unique(g)) == len(places) and not np.isin(h, g).any()
    assert S.repeated_runs(make([(1, None), (2, "")])).count() == 0


def test_repetition_in_one_text(make):
    text = "One two three four five six seven. Eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen. "
    cut = check(make, [(1, text * 4 + "End of it all."), (2, "Other words are here.")])
    assert cut[1].count("One two") == 1 and cut[1].endswith("End of it all.")
