import random
import re

import pytest
from pyspark.sql import functions as F

from docketry.llm import licences
from docketry.llm.mixing import copies, mix, mix_table, n_words
from docketry.llm.queries import page_records
from docketry.llm.warc import canonical_url, parse, read_warc, resolve

rng = random.Random(2)


# licences

MIT = """Copyright (c) 2020 Somebody

 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software, to deal in the Software without restriction. The above copyright
 * notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED
 * "AS IS", WITHOUT WARRANTY OF ANY KIND."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_licence_rules(spark):
    texts = {
        1: MIT, 2: GPL, 3: "Licensed under CC BY-NC 4.0.", 4: "Released under the MIT License.\nAll rights reserved.", 5: "x " * 100_000 + "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
        6: None, 7: "", 8: "no such thing here", 9: "Any later version is fine by us.", 10: "This work is licensed under the GNU General Public License, version 3.", 11: "SPDX-License-Identifier: MIT",
    }
    df = spark.createDataFrame([(i, t, "z") for i, t in texts.items()] + [(3, texts[3], "z")], "id long, text string, licences string")
    got = licences.recognise(df).collect()
    by = {r.id: r for r in got}
    assert sum(r.id == 3 for r in got) == 2 and not {6, 7, 8} & set(by)
    assert by[1].licences == ["MIT"] and by[1].sentence_ids == ["copyright", "mitGrant", "mitNotice", "mitAsIs"] and by[1].unknown == ["copyright"]
    assert by[2].licences == ["GPL-3.0-or-later"] and by[3].licences == ["CC-BY-NC"] and by[4].licences == ["MIT", "all-rights-reserved"]
    assert by[5].licences == ["Apache-2.0"] and by[9].licences == [] and by[9].unknown == ["anyLater"] and by[10].licences == ["GPL-3.0"] and by[11].licences == ["SPDX"]
    assert licences.recognise(df, keep_all=True).count() == len(texts) + 1
    assert licences.recognise(df.where("false")).count() == 0


#: The wording by which licences are known, as it stands in files.
LABELLED = [
    ("Zlib", """/* This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
  liable for any damages. Permission is granted to anyone to use this software for any purpose, including commercial
  applications, and to alter it and redistribute it freely. */"""),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("BSL-1.0", "// Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"),
    ("X11", MIT + """ Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to
  promote the sale, use or other dealings in this Software without prior written authorization."""),
    ("MIT", MIT),
    ("ISC", """# Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
# provided that the above copyright notice and this permission notice appear in all copies."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
  conditions are met: 1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce
  the above copyright notice. THIS SOFTWARE IS PROVIDED BY THE AUTHORS "AS IS"."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
  conditions are met: * Redistributions of source code must retain the above copyright notice. * Redistributions in binary form must reproduce the
  above copyright notice. * Neither the name of the University nor the names of its contributors may be used to endorse or promote products."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
  You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law, software distributed
  under the License is distributed on an "AS IS" BASIS."""),
    ("LGPL-2.1-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
  License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
  published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("AGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
  as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all rights: CC0 1.0 Universal."),
    ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike 4.0 licence."),
    ("CDDL", "The contents of this file are subject to the terms of the Common Development and Distribution License."),
    ("EUPL", "Licensed under the EUPL, Version 1.2 or later"), ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"), ("PSF", "PSF LICENSE AGREEMENT FOR PYTHON 3.9"),
    ("Artistic-2.0", "under the terms of the Artistic License 2.0"), ("OFL", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    (None, "the register at 0xcc0ff is set, mercc0 too"), (None, "a permit was granted; the licence plate was lost"), (None, "my cousin wtfplays and teuplo"),
]


def test_wording_of_known_licences(spark):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(LABELLED)], "id long, text string")
    got = {r.id: r.licences for r in licences.recognise(df, keep_all=True).collect()}
    assert {k: got[k] for k in got} == {k: [name] if name else [] for k, (name, _) in enumerate(LABELLED)}


def test_sentence_ids_come_in_order_of_text(spark):
    df = spark.createDataFrame([(1, "all rights reserved, copyright (c) 2020 by us"), (2, "copyright 2020, all rights reserved")], "id long, text string")
    assert {r.id: r.sentence_ids for r in licences.recognise(df).collect()} == {1: ["reserved", "copyright"], 2: ["copyright", "reserved"]}


def test_needed_words_lose_nothing(spark):
    """Every sentence rule's matches hold one of the words that the filters look for."""
    for name, pattern in licences.SENTENCES:
        for branch in pattern.split("|") if "(" not in pattern else [pattern]:
            plain = re.sub(r"\(([^()|]*)\|[^()]*\)", r"\1", branch)
            assert any(w in plain for w in licences.NEEDED), name


# mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / max(sum(w[s] for s in free), 1e-9)
        over = [s for s in free if share * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: fixed.get(s, share * w[s]) for s in names}
        fixed |= {s: most * sizes[s] for s in over}


def corpus(n=3000):
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 6 + ["a", "b", "é", "Z", None] + ["tiny"] * (i < 40))
        size = int(rng.paretovariate(1.1) * 5) % 3000
        rows.append((i, source, " ".join(["w"] * size) + rng.choice(["", " ", "\n"]), "x"))
    return [*rows, (None, "a", "one two", "x"), (None, "a", "three", "x"), (5000, "a", None, "x"), (5001, "empty", "", "x"), (5002, "b", "dup dup", "x"), (5002, "b", "dup dup", "x")]


def test_targets_and_rounding(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, source string, text string, size string").repartition(4)
    got = mix_table(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = brute_targets(sizes)
    for s, size in sizes.items():
        mine = [r for r in got if r.source == s]
        taken = sum(r.taken for r in mine)
        assert all(r.source_size == size and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s]) for r in mine)
        assert abs(taken - goal[s]) <= max(0.02 * goal[s], 60), (s, taken, goal[s])
        rate = goal[s] / size if size else 0
        assert all(r.taken <= 3 * r.size and (r.size == 0 or int(rate + 1e-9) <= r.copies <= -int(-(rate - 1e-9) // 1)) for r in mine)
    again = sorted(map(str, mix_table(df.repartition(7)).collect()))
    assert again == sorted(map(str, got))


def test_leaves_and_tree(spark, monkeypatch):
    from docketry.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "RESERVE", 8)
    rows = [(i, "s" if i % 3 else "t", " ".join(["w"] * rng.randint(1, 60))) for i in range(2000)]
    got = mix_table(spark.createDataFrame(rows, "id long, source string, text string")).collect()
    for s in "st":
        mine = [r for r in got if r.source == s]
        assert len(mine) == len([r for r in rows if r[1] == s]) and abs(sum(r.taken for r in mine) - mine[0].target) <= 60


def test_copies_are_unbiased(spark):
    rows = [(i, "s" if i < 30 else "t", " ".join(["w"] * (1 + i % 7))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    runs = [{r.id: r.copies for r in copies(df, seed=1000 * k).collect()} for k in range(12)]
    target = {r.id: r.target / r.source_size for r in copies(df).collect()}
    for lo in (0, 30):
        mean = sum(r[i] for r in runs for i in range(lo, lo + 30)) / 12 / 30
        assert abs(mean - target[lo]) < 0.08


def test_mix_repeats_rows(spark):
    rows = [(i, "s" if i % 2 else None, "word " * (i + 1), i) for i in range(20)] + [(None, None, "x y z", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")
    out = mix(df)
    assert out.columns == df.columns
    table = mix_table(df.select(F.col("doc_id").alias("id"), "source", "text")).collect()
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.id) for r in table for _ in range(r.copies))
    assert mix_table(df.where("false").select(F.col("doc_id").alias("id"), "source", "text")).count() == 0


def test_words(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc ", "a b", "é  ü\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", n_words("text").alias("n"))
    assert [r.n for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# WARC


def test_canonical_urls(spark):
    pairs = {
        "http://www.Example.com:80/a/b/?b=2&a=1&utm_source=x#frag": "example.com/a/b?a=1&b=2", "https://example.com/a/b?a=1&b=2": "example.com/a/b?a=1&b=2",
        "HTTPS://EXAMPLE.com": "example.com", "http://example.com/": "example.com", "http://example.com/A": "example.com/A", "http://m.example.com:8080/x?": "m.example.com:8080/x", None: None,
    }
    df = spark.createDataFrame([(u,) for u in pairs], "url string").select("url", canonical_url("url").alias("k"))
    assert {r.url: r.k for r in df.collect()} == pairs


def brute_resolve(rows):
    out = {}
    for i, key, date, kind, headers, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and r[1] == key and key is not None and (r[2] is not None, r[2] or 0, r[0]) < (date is not None, date or 0, i)]
        base = max(earlier, key=lambda r: (r[2] is not None, r[2] or 0, r[0]), default=None)
        h, status = headers or {}, "no_base"
        if base:
            b = base[4] or {}
            name = "etag" if "etag" in h else "last-modified"
            strip = lambda v: v.removeprefix("W/")
            status = "no_validator" if name not in h or name not in b else "resolved" if strip(h[name]) == strip(b[name]) else "validator_mismatch"
        merged = None
        if status == "resolved":
            merged = {**(base[4] or {}), **{k: v for k, v in h.items() if k in ("etag", "date", "last-modified", "cache-control")}}
        out[i] = (base and base[0], status, merged, base[5] if status == "resolved" else None)
    return out


@pytest.mark.parametrize("urls", [1, 30])
def test_revisits_by_brute_force(spark, urls):
    rows = []
    for i in range(400):
        headers = {}
        if rng.random() < 0.7:
            headers["etag"] = rng.choice(["", "W/"]) + rng.choice(['"1"', '"2"'])
        if rng.random() < 0.5:
            headers["last-modified"] = rng.choice(["mon", "tue"])
        if rng.random() < 0.5:
            headers |= {"content-type": f"t{i}", "cache-control": f"c{i}"}
        url = None if rng.random() < 0.05 else f"http://h.org/{rng.randrange(urls)}"
        rows.append((i, url, None if rng.random() < 0.03 else rng.randrange(150), rng.choice(["response", "revisit", "revisit"]), headers or None, f"body{i}"))
    rows.append((1000, "http://h.org/0", 5, "request", None, "no"))
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, url string, date long, kind string, headers map<string,string>, body string, status string").repartition(6)
    got = {r.id: (r.base_id, r.status, r.headers, r.body) for r in resolve(df, ("body",)).collect()}
    assert got == brute_resolve(rows)
    assert resolve(df.where("false"), ("body",)).count() == 0


def test_warc_files(spark, tmp_path):
    import gzip

    def record(kind, url, date, http):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(http)}\r\n\r\n".encode()
        return head + http + b"\r\n\r\n"

    one = record("warcinfo", "", "2020", b"software: x")
    two = record("response", "http://a.org/", "2020-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\nWARC/ in a body</p>")
    three = record("revisit", "http://a.org", "2021-01-01T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: W/\"1\"\r\nDate: now\r\n\r\n")
    assert [r["kind"] for r in parse(one + two + three)] == ["response", "revisit"] and not list(parse(b"")) and not list(parse(b"WARC/1.0\r\ncut"))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, (one, two, three))))
    found = resolve(read_warc(spark, str(tmp_path)), ("body",)).collect()
    assert len(found) == 1 and found[0].status == "resolved" and bytes(found[0].body).endswith(b"body</p>")
    assert found[0].headers == {"etag": 'W/"1"', "content-type": "text/html", "date": "now"}
    bad = two.replace(b"Content-Length: ", b"Content-Length: x")
    assert [r["kind"] for r in parse(bad + three)] == ["revisit"] and [r["kind"] for r in parse(gzip.compress(two) + b"\x1f\x8bdamaged")] == ["response"]
    many = b"".join(gzip.compress(record("response", f"http://a.org/{i}", "2020", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 3_000_000)) for i in range(9))
    (tmp_path / "y.warc.gz").write_bytes(many)
    assert read_warc(spark, str(tmp_path / "y.warc.gz")).selectExpr("count(*)", "min(length(body))").first() == (9, 3_000_000)


def test_only_full_responses_and_not_modified_revisits(spark):
    tag, uri = {"etag": '"1"'}, "http://netpreserve.org/warc/1.1/revisit/"
    rows = [
        (1, "http://a.org/", 1, "response", tag, 200, None, "full"), (2, "http://a.org/", 2, "response", tag, 404, None, "missing"), (3, "http://a.org/", 3, "response", tag, 206, None, "part"),
        (4, "http://a.org/", 4, "revisit", tag, 304, uri + "server-not-modified", None), (5, "http://a.org/", 5, "revisit", tag, 200, uri + "identical-payload-digest", None), (6, "http://a.org/", 6, "revisit", tag, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, url string, date long, kind string, headers map<string,string>, status int, profile string, body string")
    got = {r.id: (r.base_id, r.status, r.body) for r in resolve(df, ("body",), "status", "profile").collect()}
    assert got == {4: (1, "resolved", "full"), 5: (None, "other_profile", None), 6: (1, "resolved", "full")}


def test_records_that_share_id_and_date(spark):
    rows = [(1, "http://a.org/", 1, "response", {"etag": '"1"'}, b) for b in ("x", "y", "x")] + [(1, "http://b.org/", 1, "response", {"etag": '"1"'}, "z")]
    rows += [(9, "http://a.org/", 2, "revisit", {"etag": '"1"', "date": d}, None) for d in ("p", "q", "p")] + [(9, "http://b.org/", 2, "revisit", {"etag": '"1"'}, None)]
    schema = "id long, url string, date long, kind string, headers map<string,string>, body string"
    runs = [sorted((r.headers.get("date"), r.body) if r.body != "z" else ("", "z") for r in resolve(spark.createDataFrame(rows, schema).repartition(n), ("body",)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and [d for d, _ in runs[0]] == ["", "p", "p", "q"] and len({b for _, b in runs[0]}) == 2


def test_page_records(spark):
    pages = spark.createDataFrame([(2, "http://a.org/x#1", "<title>T</title>"), (1, "https://a.org/x/", "<title>T</title>"), (3, None, None)], "page_id long, url string, html string")
    got = resolve(page_records(pages), ("body_bytes",)).collect()
    assert [(r.id, r.base_id, r.status, r.body_bytes) for r in got] == [(2, 1, "resolved", 16)]


#: Short names, headings and versions; what is denied or only resembles a licence's name has none.
NAMED = [
    (["MPL-1.1"], "subject to the Mozilla Public License, v. 1.1 only"), (["MPL-1.1"], "Mozilla Public License Version 1.1"), (["MPL-2.0"], "the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed"),
    (["GPL-2.0"], "GNU General Public License v2.0"), (["GPL-2.0"], "License: GNU General Public License v2."), (["GPL-3.0"], "Licensed under GPLv3"), (["GPL-3.0"], "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007"),
    (["GPL-2.0"], "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991"), (["LGPL-2.1"], "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"), (["AGPL-3.0"], "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    (["GPL-3.0-or-later"], "released as GPL-3.0-or-later"), (["GPL-2.0-or-later"], "this is GPLv2+ code"), (["LGPL-3.0"], "the LGPLv3"), (["LGPL-2.1-or-later"], "LGPL-2.1+"), (["AGPL-3.0"], "It is AGPLv3."), (["GPL-2.0", "SPDX"], "SPDX-License-Identifier: GPL-2.0-only"),
    (["GPL-2.0"], "under the terms of the GNU General Public License, version 2."), (["MIT"], "MIT License"), (["MIT"], "License: MIT"), (["Apache-2.0"], "                                 Apache License\n                           Version 2.0, January 2004"),
    ([], "This is not released under the MIT license."), ([], "The code is no longer licensed under the Apache License, Version 2.0."), ([], "It is not distributed under the terms of the GNU General Public License, version 2 or any later version."),
    (["GPL-3.0"], "It is not released under the MIT license. Licensed under GPLv3."), ([], "the gplv34 board"), ([], "our mygpl-3 tool"), ([], "license: mitigated"), ([], "he lost v. 2 of the book about licences"), ([], "GPL-1 was old"), ([], "lgpl 2.15"),
]


def test_licences_by_name_version_and_heading(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(NAMED)], "id long, text string")
    got = {r.id: r.licences for r in licences.recognise(df, keep_all=True).collect()}
    assert [(t, got[i]) for i, (_, t) in enumerate(NAMED)] == [(t, w) for w, t in NAMED]


def test_licences_agree_with_the_sql_on_names(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(NAMED)])
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(NAMED)], "id long, text string")
    ours = {(r.id, ",".join(r.sentence_ids), ",".join(r.licences), ",".join(r.unknown)) for r in licences.recognise(df).collect()}
    assert ours == set(con.execute(f"SELECT doc_id, sentence_ids, licences, unknown FROM ({licences.oracle()})").fetchall())
