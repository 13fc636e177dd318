"""Exact round trips of chunked media and coded ids; packing and licences."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from veritally.llm import licences, media_chunks, packing, range_coder, token_output

DOC = "doc_id long, text string"
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def payload(t):
    raw = (t or "").encode()
    return len(raw), raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))


def test_media_round_trip(docs, corpus):
    got = {r.doc_id: r for r in media_chunks.chunked_media(docs).collect()}
    assert len(got) == len(corpus)
    lists = {}
    for d, t in corpus:
        n, p = payload(t)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        stored = media_chunks.chunk_list(p)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert lists.setdefault(p, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_chunks_are_stored_once(spark, docs, corpus):
    _, stored = media_chunks.store(docs)
    rows = stored.collect()
    kept = [r.name for r in rows if r.name is not None]
    assert len(kept) == len(set(kept))
    places = sum(len(media_chunks.chunks(p)) for p in {payload(t)[1] for _, t in corpus})
    distinct = {media_chunks.digest(c) for _, t in corpus for c in media_chunks.chunks(payload(t)[1])}
    own = sum(len(media_chunks.read_list(r.list)[1]) - len(r.shared) for r in rows if r.media is not None)
    assert own + len(kept) == len(distinct) <= places


def test_cuts_follow_content():
    rng = random.Random(3)
    body = bytes(rng.randrange(32, 127) for _ in range(200_000))
    a, b = set(media_chunks.chunks(body)), set(media_chunks.chunks(b"some new start" + body))
    assert len(a & b) > 0.9 * len(a)
    for p in (body, b" " * 100_000, b" " * 192):
        parts = media_chunks.chunks(p)
        assert b"".join(parts) == p and all(len(c) <= media_chunks.MAX_CHUNK for c in parts) and all(len(c) >= media_chunks.MIN_CHUNK for c in parts[:-1])
        assert media_chunks.rebuild(media_chunks.chunk_list(p), parts) == p
    with pytest.raises(ValueError):
        media_chunks.rebuild(media_chunks.chunk_list(b" " * 192), [b"x" * 192])
    slow = 0
    for c in body[:64]:
        slow = (slow * 2 + int(media_chunks._gear[c])) % 2**32
    h = media_chunks._gear[np.frombuffer(body[:64], np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    assert int(h[-1]) == slow


def test_media_edges(spark):
    assert media_chunks.chunked_media(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "only here"), (1, "a"), (1, "b"), (1, "a"), (None, None), (2, "a")]
    got = sorted((r.doc_id or 0, r.n_bytes, r.payload_sha256) for r in media_chunks.chunked_media(spark.createDataFrame(rows, DOC)).collect())
    assert got == sorted((d or 0, payload(t)[0], hashlib.sha256(payload(t)[1]).hexdigest()) for d, t in rows)


def test_tokens_equal_the_library(docs, corpus):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in token_output.token_blocks(docs, PATH).collect()}
    for d, t in corpus:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_units_equal_whole_texts():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(PATH), token_output.Encoder(PATH), random.Random(6)
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "'s", "don't", "12", "é", " ", " ", "　", "!!", "<|endoftext|>", "<", "\x1c", "\x85", "日本", "\r\n", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    for t, ids in zip(texts, own.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_unit_is_looked_up_once_for_many_texts():
    class Counted(dict):
        looks = 0

        def get(self, *key):
            self.looks += 1
            return super().get(*key)

    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PATH), token_output.Encoder(PATH)
    own.number = Counted()
    texts = [f"{k % 7} words, again and again; ünits of {k % 5} texts" * 40 for k in range(1500)]  # more than 2 MB
    for _ in range(2):
        got = [ids.tolist() for ids in own.encode(pa.array(texts))]
        assert got[:70] == [library.encode(t, add_special_tokens=False).ids for t in texts[:70]] and len(got) == 1500
    assert len(own.number) < 100 and own.number.looks == 2 * len(own.number)


def test_token_edges(spark):
    assert token_output.token_blocks(spark.createDataFrame([], DOC), PATH).count() == 0
    rows = [(None, "x"), (3, "b"), (3, "a"), (1, None), (2, "")]
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_output.token_blocks(spark.createDataFrame(rows, DOC), PATH).collect())
    assert [(d, n) for _, d, n in got] == [(None, 2), (1, 1), (2, 1), (3, 2), (3, 2)] and [s for s, _, _ in got] == [0, 2, 3, 4, 6]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 128, 1000, 5000, 70_001])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50258, n), np.minimum(rng.exponential(40, n).astype(int), 50257), np.zeros(n, int), np.full(n, 50257), np.arange(n) % 7):
        block = range_coder.encode(ids, 50258)
        assert (range_coder.decode(block) == ids).all()
    if n > 1000:
        assert len(block) < n / 2  # order 2 knows the cycle
        for damaged in (block[:-1], block[:40] + bytes([block[40] ^ 1]) + block[41:]):
            with pytest.raises(ValueError):
                range_coder.decode(damaged)


def test_orders_1_and_2_help():
    """Ids of real texts take clearly fewer bits than their order-0 entropy."""
    rows = pytest.importorskip("pyarrow.parquet").read_table("/root/testdata/sf0.01/documents.parquet")["text"]
    ids = np.concatenate(list(token_output.Encoder(PATH).encode(rows))).astype(np.int64)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    block = range_coder.encode(ids, 50258)
    assert (range_coder.decode(block) == ids).all()
    print(f"{8 * len(block) / len(ids):.2f} bits an id, order 0 {entropy:.2f}")
    assert 8 * len(block) / len(ids) < 0.97 * entropy
    # a context with two followers: a distribution and not a guess
    rng = np.random.default_rng(1)
    pairs = np.stack([rng.integers(0, 500, 200_000), np.zeros(200_000, np.int64)], axis=1)
    pairs[:, 1] = 1000 + 2 * pairs[:, 0] + (rng.random(200_000) < 0.5)
    assert 8 * len(range_coder.encode(pairs.ravel(), 50258)) / 400_000 < 0.62 * np.log2(500 * 2000) / 2 + 1.3


def test_units_that_collide_under_a_polynomial_hash():
    from tokenizers import Tokenizer

    bits = [0]
    while len(bits) < 1024:
        bits += [1 - x for x in bits]
    texts = ["x " + "".join("ab"[x] for x in bits), "x " + "".join("ba"[x] for x in bits)]
    library = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in token_output.Encoder(PATH).encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_of_long_texts_and_clashing_columns(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = ["long words " * 60_000, "z" * 100_000, "short"]
    df = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in enumerate(texts)], "doc_id long, text string, part long, block long, start long")
    got = [r.n_tokens for r in token_output.token_blocks(df, PATH).orderBy("doc_id").collect()]
    assert got == [len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    media = {r.doc_id: r.n_bytes for r in media_chunks.chunked_media(df.withColumnsRenamed({"part": "media", "block": "names", "start": "at"})).collect()}
    assert media == {i: len(t) for i, t in enumerate(texts)}


def test_blocks_stand_alone(spark, docs, corpus):
    blocks = token_output.write(docs, PATH, block_ids=1000).collect()
    assert len(blocks) > 10
    seen = [k for b in sorted(blocks, key=lambda b: (b.part, b.block)) for k in token_output.read_block(b.data)[0]]
    assert seen == sorted(d for d, _ in corpus)


def _best_fit(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fit = [(r, i) for i, (r, ss, cc) in enumerate(bins) if r >= n and r > 0 and (s < 0 or s not in ss) and (c < 0 or c not in cc)]
        if fit:
            i = min(fit)[1]
        else:
            bins.append((capacity, set(), set()))
            i = len(bins) - 1
        r, ss, cc = bins[i]
        bins[i] = (r - n, ss | {s}, cc | {c})
        out.append(i)
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randrange(0, 80)
        lengths = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=True)
        sources, clusters = [rng.randrange(-1, 4) for _ in range(n)], [rng.randrange(-1, 9) for _ in range(n)]
        assert packing.best_fit(lengths, sources, clusters, 100) == _best_fit(lengths, sources, clusters, 100)


def test_packing_rules(docs, corpus):
    rows = packing.pack(docs, capacity=100, shard_docs=20).collect()
    text, source = dict(corpus), {d: (f"src{d % 4}" if d % 5 else None) for d, _ in corpus}
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.shard, r.bin].append(r)
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(text)
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [100 * i for i in range(len(own))]
        assert sum(r.n_tokens for r in own) == len((text[d] or "").encode().split()) + 1
    for own in bins.values():
        own.sort(key=lambda r: r.bin_start)
        assert sum(r.n_tokens for r in own) <= 100 and [r.bin_start for r in own] == [sum(x.n_tokens for x in own[:i]) for i in range(len(own))]
        s = [source[r.doc_id] for r in own if source[r.doc_id]]
        c = [tuple((text[r.doc_id] or "").lower().split()) for r in own]
        assert len(s) == len(set(s)) and len(c) == len(set(c))
    assert packing.pack(docs.limit(0)).count() == 0
    assert sorted(map(tuple, packing.pack(docs.repartition(7), 100, 20).collect())) == sorted(map(tuple, rows))


def test_licence_rules(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A. Author\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
    grant = licences.SENTENCES["mit-grant"]
    texts = ["Words here. Licensed under the Apache License, Version 2.0.\nMore words.", "no end |\nReleased under the MIT License.\nx", mit.replace("conditions:\n\nThe", "conditions:\nThe"), f"{licences.SENTENCES['mit-asis']}. {grant}.", f"{grant}. other. {licences.SENTENCES['mit-asis']}!", "a licence of no kind", None, "", "Licensed under CC BY-NC 4.0. Released under the MIT license"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licences string")
    got = [r.licences for r in licences.scan(df).orderBy("doc_id").collect()]
    assert got == ["Apache-2.0", "MIT", "MIT", "", "MIT", "", "", "", "MIT,CC-BY-NC-4.0"]
    known = licences.SENTENCES | licences.MORE_SENTENCES
    assert all(any(c in known[k] for k in ids for c in licences.CUES) for _, ids in licences.RULES + licences.MORE_RULES)
    assert licences.scan(df.limit(0)).count() == 0


def test_licences_of_unedited_texts(spark):
    mit = """Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
    agpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details."""
    no_grant = "MIT License\n\n" + mit[mit.index("THE SOFTWARE IS") :]
    texts = ["MIT License\n\n" + mit, mit, no_grant, mpl, "/* " + mpl.replace("\n", "\n * ") + " */", agpl, "MIT License", "See v. 2 of it, no license."]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licences for r in got] == ["MIT", "MIT", "MIT", "MPL-2.0", "MPL-2.0", "AGPL-3.0-or-later", "", ""]


def test_licences_by_clauses_tags_and_waivers(spark):
    head = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
    endorse = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
    as_is = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE."""
    unlicense = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
    epl = """ * This program and the accompanying materials are made
 * available under the terms of the Eclipse Public License 2.0
 * which is available at https://www.eclipse.org/legal/epl-2.0/
 *
 * SPDX-License-Identifier: EPL-2.0"""
    cc0 = "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. x"
    texts = [head + as_is, head + endorse + as_is, unlicense, epl, cc0, "CC0 1.0 Universal\n", "#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-only\nx", "word " * 200_000 + ".\n// SPDX-License-Identifier: MIT", unlicense.split("\n\n")[1], head]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licences for r in got] == ["BSD,BSD-2-Clause", "BSD,BSD-3-Clause", "Unlicense", "EPL-2.0", "CC0-1.0", "CC0-1.0", "GPL-2.0-only", "MIT", "", "BSD"]


NAMING = {
    "This project is licensed under the MIT License - see the LICENSE.md file for details.": "MIT",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "SPDX: Apache-2.0 OR MIT": "Apache-2.0,MIT",
    "// SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) OR MIT": "GPL-2.0-or-later,MIT",
    "SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only",
    "x SPDX-License-Identifier: LGPL-2.1-only */": "LGPL-2.1-only",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "This text is available under the Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0",
    "Dual licensed under the MIT license and the Apache License, v. 2.0.": "MIT,Apache-2.0",
    "This program is distributed under the terms of the GNU General Public Licence version 2 or any later version.": "GPL-2.0-or-later",
    "Released under the GNU LGPL v3 (https://www.gnu.org/licenses/lgpl-3.0.html)": "LGPL-3.0-only",
    "Licensed under the MIT and something of ours.": "",
    "Licensed under no terms at all, see the MIT license": "",
    "The door was left open. We walked in under the mit of a spdx.": "",
}
COMMON = "/usr/share/common-licenses"
UNEDITED = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD,BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_licences_called_by_name_and_unedited_texts_as_in_sql(spark):
    """Names, expressions, tails and whole texts, and the SQL of the whole catalogue on the same rows."""
    import duckdb
    import pandas as pd

    want = dict(NAMING)
    if os.path.isdir(COMMON):
        texts = {f: open(f"{COMMON}/{f}", errors="replace").read() for f in UNEDITED if os.path.isfile(f"{COMMON}/{f}")}
        want |= {text: UNEDITED[f] for f, text in texts.items()}
        notice = texts["GPL-2"][texts["GPL-2"].index("    This program is free software; you") :].split("    You should have")[0]
        want |= {notice: "GPL-2.0-or-later", notice + "\n\n" + texts["GPL-2"]: "GPL-2.0-or-later,GPL-2.0-only", texts["GPL-3"] + "\n\n" + notice: "GPL-3.0-only,GPL-2.0-or-later"}
    rows = [(i, text) for i, text in enumerate(want)] + [(None, "Licensed under the MIT"), (None, "Licensed under the MIT"), (0, next(iter(want))), (-1, None), (-2, "")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    found = {r.doc_id: r.licences for r in got.itertuples() if r.doc_id >= 0}
    for i, text in enumerate(want):
        assert found[i] == want[text], text[:90]
    assert len(got) == len(rows) and list(got[got.doc_id.isna()].licences) == ["MIT", "MIT"]
    assert all(any(re.search(c, "licensed under " + name) for c in licences.CUES) for name in licences.NAMES)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}))
    sql = con.execute(licences.ORACLE_SQL).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, sql)) == sorted(key((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_sentences, r.sentences, r.licences)) for r in got.itertuples())


def test_packing_of_nulls_repeats_and_named_clusters(spark):
    rows = [(None, "a b", None, None, 1)] * 2 + [(1, "c d", "s", None, 2), (2, "e f", None, "k", 3), (3, "g h", None, "k", 4), (4, "i j", None, None, 5), (4, "i j", None, None, 5), (5, None, None, None, 6), (6, "", "s", None, 7), (7, "z " * 5000, None, "k", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster string, shard int")
    for got in (packing.pack(docs, 100, cluster="cluster").toPandas(), packing.pack(docs, 100).toPandas()):
        assert got.n_tokens.sum() == 2 * 3 + 3 * 3 + 2 * 3 + 1 + 1 + 5001 and got.groupby(["shard", "bin"]).n_tokens.sum().max() <= 100
        assert (got.doc_id == 4).sum() == 2 and got.doc_id.isna().sum() == 2
    named = packing.pack(docs, 100, cluster="cluster").toPandas()
    bin_of = {(r.doc_id, r.piece): r.bin for r in named.itertuples()}
    assert len({bin_of[2, 0], bin_of[3, 0], bin_of[7, 50]}) == 3 and bin_of[1, 0] != bin_of[6, 0]
    free = named[named.doc_id.isna() | named.doc_id.isin([4, 5])]  # without source and cluster, in no conflict
    assert free.bin.nunique() == 1


def test_repeated_rows_are_dealt_to_shards(spark):
    """A third and more of all rows equal, without doc_id: no shard holds more than its share."""
    rows = spark.createDataFrame([(None, "the same few words", "s")] * 4000 + [(i, f"other {i}", "s") for i in range(2000)], "doc_id long, text string, source string")
    got = packing.pack(rows, capacity=64, shard_docs=500)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert sum(sizes) == 6000 and len(sizes) == 12 and max(sizes) < 800
