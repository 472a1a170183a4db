import math
import re

import pytest

from foldspark.llm import licences as S

from .conftest import prose

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_base(text):
    words = words_of(text)
    places = sorted((i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    labels = ",".join(sorted({x for _, x in places}))
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, labels


def brute_method(texts):
    """Votes counted one by one, in plain Python, of every word of the index."""
    docs = [words_of(t) for t in texts]
    held = [set(d) for d in docs]
    vocabulary = {w for _, notice, _ in S.NOTICES for w in words_of(notice)}
    idf = {w: math.log((len(docs) + 1) / (sum(w in d for d in held) + 1)) + 1e-6 for w in vocabulary}
    out = []
    for words in docs:
        found = {}
        for label, notice, phrases in S.NOTICES:
            notice, votes = words_of(notice), {}
            rare = sorted(set(notice), key=lambda w: (-idf[w], w))[: S.RARE]
            for i, w in enumerate(words):
                if w in rare:
                    votes[i - notice.index(w)] = votes.get(i - notice.index(w), 0) + idf[w]
            best = max(votes.values(), default=0) / sum(idf[w] for w in rare)
            if best >= S.SHARE - 1e-12 and all(f" {p} " in f" {' '.join(words)} " for p in phrases):
                found[label] = max(min(best, 1.0), found.get(label, 0))
        out.append(found)
    return out


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3. MIT license; cc-by CC BY-NC 4.0",
    "Licensed under CC BY-NC 4.0.",
    "apache license apache license APACHE LICENSE mit license",
    prose(1, 300) + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software " + prose(2, 50),
    "permission software granted charge person copy free obtaining hereby",
    "Redistribution and use in source and binary forms, with or without\n modification, are permitted provided that",
    "license " * 3000,
    "été Ünder cc bÿ cc by 一cc by",
    "xapache license apache licenses gnu general public",
    prose(3, 100),
    "Copyright. All rights reserved.",
]


def test_equals_brute_force(make, edge_rows):
    rows = [*edge_rows, *[(100 + i, t) for i, t in enumerate(TEXTS)], *[(300 + i, prose(300 + i, 60)) for i in range(40)]]
    found = S.scan(make(rows)).collect()
    methods = brute_method([r[1] for r in rows])
    assert len(found) == len(rows)
    for (i, text, *_), r, method in zip(rows, found, methods, strict=True):
        n, base, first, last, labels = brute_base(text)
        assert (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (i, n, base, first, last, labels), text
        assert r["labels"] == ",".join(sorted({*filter(None, labels.split(",")), *method})), text
        assert r["score"] == pytest.approx(max(method.values(), default=0.0), abs=1e-6)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[100]["labels"] == "apache,apache-2.0" and by_id[102]["labels"] == "cc-by,cc-by-nc-4.0"
    assert "gpl-3.0" in by_id[101]["labels"] and "gpl-2.0" not in by_id[101]["labels"]
    assert "mit-notice" in by_id[104]["labels"] and by_id[105]["labels"] == "" and by_id[106]["labels"] == "bsd"


def test_native_plan_and_empty_table(make, edge_rows):
    plan = S.scan(make(edge_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert S.scan(make(edge_rows).limit(0)).count() == 0


def test_several_notices_in_one_text(make):
    own = {label: notice for label, notice, _ in reversed(S.NOTICES)}
    sets = [["mit-notice", "bsd", "apache-2.0"], ["bsd", "isc", "mit-notice", "unlicense", "gpl-3.0", "apache-2.0"], sorted(set(own) - {"bsd-3-clause"})]
    texts = [(" " + prose(7, 2000) + " ").join(own[k] for k in labels) for labels in sets]
    texts.append(texts[0] + " " + " ".join(sorted({w for _, n, _ in S.TEMPLATES for w in n})))
    rows = [(i, t) for i, t in enumerate([*texts, *[prose(300 + i, 60) for i in range(40)]])]
    found = {r["doc_id"]: r for r in S.scan(make(rows)).collect()}
    for (i, text), method in zip(rows, brute_method([t for _, t in rows]), strict=True):
        assert found[i]["labels"] == ",".join(sorted({*filter(None, brute_base(text)[-1].split(",")), *method}))
        assert found[i]["score"] == pytest.approx(max(method.values(), default=0.0), abs=1e-6)
    for i, labels in enumerate([*sets, sets[0]]):
        assert set(labels) <= set(found[i]["labels"].split(","))


CANONICAL = [
    ("gpl-3.0", "foo is free software: you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."),
    ("gpl-2.0", "# under the terms of the GNU General Public License version 2 as\n# published by the Free Software Foundation."),
    ("gpl-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published"),
    ("apache-2.0", "// You may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this"),
    ("mpl-2.0", "Mozilla Public License Version 2.0\n=================================="),
]


def test_canonical_headers_are_found(make):
    rows = [(i, f"{prose(i, 30)}\n/*\n{text}\n*/\n{prose(i + 50, 30)}") for i, (_, text) in enumerate(CANONICAL)]
    found = {r["doc_id"]: r["labels"].split(",") for r in S.scan(make([*rows, *[(100 + i, prose(300 + i, 60)) for i in range(40)]])).collect()}
    for i, (label, text) in enumerate(CANONICAL):
        assert label in found[i], text
    assert "gpl-2.0" not in found[0] and "gpl-3.0" not in found[1]
    assert all(found[100 + i] == [""] for i in range(40))


def test_sql_gives_the_same_rows(make, tmp_path):
    import duckdb

    from foldspark.llm.oracles import LICENCES

    texts = [*TEXTS, " ".join(n for _, n, _ in S.NOTICES), *[t for _, t in CANONICAL], None, "", *[prose(i, 50) for i in range(20)]]
    docs = make(list(enumerate(texts)))
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    wanted = sorted(map(str, db.execute(f"SELECT doc_id, n_words, n_base, labels, round(score, 4) FROM ({LICENCES})").fetchall()))
    assert wanted == sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["labels"], round(r["score"], 4))) for r in S.scan(docs).collect())
