"""URL filter, licence scan and ring sharding against brute force and on odd inputs."""

import zlib
from collections import Counter

from tidemark.llm import license_scan, ring_shard, url_filter


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end].lower(), rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    urls = ["http://a.EXAMPLE.com/en/72?x", "https://com/en/", "http://x.com/en", "ftp://example.net/de/81#a", "http://net/de/", None, "", "no scheme", "http://", "http://a.com?q=/en/", "http://notcom/en/", "x://a.org/es/" + "y" * 50_000, "http://a.b.c.d.example.com/en/7", "http://a.com./en/"] * 2
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(frame, url_filter.default_rules(spark)).collect()}
    assert got == {i: brute_verdict(u, url_filter.RULES) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(frame.limit(0), url_filter.default_rules(spark)).count() == 0
    none = url_filter.default_rules(spark).limit(0)
    assert {r.verdict for r in url_filter.filter_urls(frame, none, default="block").collect()} == {"block"}


def test_licences(spark):
    texts = [
        "Foo bar. Licensed under the Apache License, Version 2.0. More", "MIT License\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nfoo\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
        "All rights reserved.", None, "", "word " * 100_000, "Released under the MIT License. Released under the MIT License.", "mit license", "\u0001 all rights reserved \u0001",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_unmatched) for r in license_scan.scan_licenses(frame).collect()}
    assert got == {0: (["Apache-2.0"], 0), 1: (["MIT"], 0), 2: (["Proprietary"], 0), 3: ([], 0), 4: ([], 0), 5: ([], 0), 6: (["MIT"], 0), 7: ([], 1), 8: (["Proprietary"], 0)}


def brute_ring(rows, shards, points):
    import hashlib

    def key(i):
        return int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16)

    width = (1 << 60) // ring_shard.BUCKETS
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    out, slots = [], Counter()
    for i, text in sorted(rows, key=lambda r: (key(r[0]), len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode()))):
        at = next((n for n, p in enumerate(points) if p[0] >= key(i) // width), len(points))
        while slots[s := points[at % len(points)][1]] >= room[s]:
            at += 1
        out.append((i, len((text or "").encode()) + 1, zlib.crc32((text or "").encode()), s, slots[s]))
        slots[s] += 1
    return out


def test_ring(spark):
    rows = [(i, f"text {i % 50}") for i in range(500)] + [(7, "same")] * 300 + [(None, None), (None, ""), (3, "é" * 10_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ring_shard.shard_rows(frame, 8).collect()]
    points = ring_shard.ring_points(8, ring_shard.POINTS_PER_SHARD, ring_shard.BUCKETS)
    assert Counter(got) == Counter(brute_ring(rows, 8, points))
    assert ring_shard.shard_rows(frame.limit(0), 8).count() == 0


def test_ring_with_one_hot_id_and_clashing_names(spark):
    rows = [(5, f"text {i % 700}", 1, 1) for i in range(900)] + [(5, "same", 2, 2)] * 500 + [(i, "x", 3, 3) for i in range(100)] + [(None, str(i), 4, 4) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int, bucket int")
    got = [tuple(r) for r in ring_shard.shard_rows(frame, 8).collect()]
    assert Counter(got) == Counter(brute_ring([r[:2] for r in rows], 8, ring_shard.ring_points(8, ring_shard.POINTS_PER_SHARD, ring_shard.BUCKETS)))
    sizes = Counter(r[3] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_null_urls_meet_in_no_task(spark):
    rows = [(i, None if i % 10 else f"http://a{i}.com/en/{i}") for i in range(2_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    out = url_filter.filter_urls(frame, url_filter.default_rules(spark))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {i: brute_verdict(u, url_filter.RULES) for i, u in rows}


def test_licence_precedence_names_and_empty_tables(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    names = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    apache = "Licensed under the Apache License, Version 2.0 (the License). You may not use this file except in compliance with the License. You may obtain a copy of the License at"
    frame = spark.createDataFrame([(0, bsd, "z"), (1, bsd + names, "z"), (2, apache, "z"), (3, bsd + " All rights reserved.", "z")], "doc_id long, text string, licenses string")
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(frame).collect()}
    assert got == {0: ["BSD-2-Clause"], 1: ["BSD-3-Clause"], 2: ["Apache-2.0"], 3: ["BSD-2-Clause", "Proprietary"]}
    assert license_scan.scan_licenses(frame.limit(0)).count() == 0


def test_more_licences(spark):
    texts = {
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Zlib": "This software is provided 'as-is', without any express or implied warranty.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. x",
        "CC0-1.0": "CC0 1.0 Universal",
        "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; x",
    }
    frame = spark.createDataFrame(list(texts.items()), "want string, text string")
    assert {r.want: r.licenses for r in license_scan.scan_licenses(frame).collect()} == {k: [k] for k in texts}
