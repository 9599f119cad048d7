"""License scan, personal data, quality rules, URL filter: against plain versions and on odd inputs."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import reference as plain
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import boosting, license_rules, license_scan, pii, quality, queries, url_filter


LICENSE_RULES = [r | {"pattern": re.compile(r["pattern"])} for r in license_rules.rules()]


def plain_license(text):
    w = plain.words(text)
    norm, found, base = " " + " ".join(w) + " ", [], []
    norm = regex.sub(license_rules.EXPRESSION, lambda m: f"{m[1] or ''}{m[2]} {license_rules.JOINER}", norm)
    for r in LICENSE_RULES:
        for m in r["pattern"].finditer(norm):
            start, length = norm[: m.start()].count(" ") - 1, m[0].count(" ") + 1
            found.append((start, length, r["priority"], r["rule"], r["label"], r["score"]))
            if r["base"]:
                base.append((start, r["label"]))
    found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
    kept = [d for i, d in enumerate(found) if not any(e[0] + e[1] >= d[0] + d[1] and e[2] >= d[2] for e in found[:i])]
    return len(w), sorted(base), kept


def test_license_scan_matches_plain(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op1_license_scan(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        n, base, kept = plain_license(text)
        starts = [s for s, _ in base]
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(base), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert r["labels"] == ",".join(sorted({x for _, x in base} | {d[4] for d in kept}))
        assert r["score"] == max((d[5] for d in kept), default=0.0)


def test_license_rules_overlap_and_odd_texts(spark, odd_documents, no_documents):
    texts = [
        "Licensed under the Apache License, Version 2.0", "cc by cc by CC-BY-SA 4.0", "All rights reserved all rights reserved",
        "SPDX-License-Identifier: MIT License. GNU General Public License v3 or any later version", "mit licence; copyright (c) 2019 2020 Foo", "cc", "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in license_scan.scan_licenses(df).collect():
        n, base, kept = plain_license(texts[r["id"]])
        assert (r["n_words"], [(b["start"], b["label"]) for b in r["base"]]) == (n, base)
        assert sorted((d["start"], d["length"], d["label"]) for d in r["found"]) == sorted((d[0], d[1], d[4]) for d in kept)
    got = license_scan.scan_licenses(odd_documents).collect()
    assert len(got) == odd_documents.count() and sorted(r["n_words"] for r in got if r["id"] is None) == [0, 60]
    assert license_scan.scan_licenses(no_documents).count() == 0


def test_license_scan_of_very_many_matches(spark):
    """A text of 100,000 matches of one rule, and others'."""
    text = "all rights reserved copyright 2020 x " * 50_000
    (r,) = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert r["n_words"] == 300_000 and len(r["base"]) == 50_000 and len(r["found"]) == 100_000
    assert [d["start"] for d in r["found"][:4]] == [0, 3, 6, 9]


def test_license_sentences(spark):
    """What a rule needs at least stands in every match, so that no gate hides one."""
    cases = {
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "under the same terms as Perl itself": "artistic",
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "gpl-2.0+",
        "Neither the name of the Foo University nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
        "This is free and unencumbered software released into the public domain": "unlicense", "released under the CreativeML OpenRAIL-M license": "openrail",
        "the software shall be used for Good, not Evil": "json", "The Universal Permissive License (UPL) v1": "upl-1.0", "Unauthorized copying of this file is strictly prohibited": "proprietary",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    for r in license_scan.scan_licenses(df).collect():
        text = list(cases)[r["id"]]
        assert cases[text] in {d["label"] for d in r["found"]}, text
        assert sorted((d["start"], d["length"], d["label"]) for d in r["found"]) == sorted((d[0], d[1], d[4]) for d in plain_license(text)[2])


def test_license_identifiers_of_real_tags(spark):
    tags = {
        "MIT": "mit", "Apache-2.0": "apache-2.0", "BSD-3-Clause": "bsd-3-clause", "BSD-2-Clause": "bsd-2-clause", "MPL-2.0": "mpl-2.0", "ISC": "isc", "EPL-2.0": "epl-2.0",
        "GPL-2.0-only": "gpl-2.0", "GPL-2.0-or-later": "gpl-2.0+", "LGPL-2.1-or-later": "lgpl-2.1+", "AGPL-3.0-only": "agpl-3.0", "CC0-1.0": "cc0", "0BSD": "bsd-0-clause", "MS-PL": "ms-pl",
        "Zlib": "zlib", "BSL-1.0": "bsl-1.0", "Unlicense": "unlicense", "Apache-2.0 WITH LLVM-exception": "apache-2.0",
        "MIT OR Apache-2.0": "apache-2.0,mit", "(GPL-2.0-only WITH Linux-syscall-note)": "gpl-2.0", "Apache-2.0 WITH LLVM-exception OR MIT OR Zlib": "apache-2.0,mit,zlib",
    }
    cases = [(f"// SPDX-License-Identifier: {t}\nint main;", 1.0, w) for t, w in tags.items()]
    cases += [("released under MIT", 0.9, "mit"), ("distributed under Apache-2.0.", 0.9, "apache-2.0"), ("licensed under Apache-2.0", 0.95, "apache-2.0"), ("available under X11 and mitigated", 0.0, "")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id bigint, text string")
    for r in license_scan.scan_licenses(df).collect():
        text, score, labels = cases[r["id"]]
        n, _, kept = plain_license(text)
        assert sorted((d["start"], d["length"], d["label"]) for d in r["found"]) == sorted((d[0], d[1], d[4]) for d in kept)
        top = [d for d in r["found"] if d["score"] == score]
        assert (max((d["score"] for d in r["found"]), default=0.0), ",".join(sorted({d["label"] for d in top}))) == (score, labels), text


def test_license_expressions_of_any_length(spark):
    """All operands of a tag, from one to dozens, in brackets, with exceptions and references of one's own."""
    names = {"MIT": "mit", "LGPL-2.1-only": "lgpl-2.1", "BSD-3-Clause": "bsd-3-clause", "ISC": "isc", "GPL-2.0-or-later WITH Classpath-exception-2.0": "gpl-2.0+", "Zlib": "zlib",
             "LicenseRef-Our-Own-1.0": None, "Apache-2.0 WITH LLVM-exception": "apache-2.0", "MPL-2.0": "mpl-2.0", "CC0-1.0": "cc0", "GPL-2.0-only WITH Linux-syscall-note": "gpl-2.0"}
    order = list(names)
    cases = [(f"/* SPDX-License-Identifier: ({' AND '.join(order[:n])}) */", set(order[:n])) for n in range(1, len(order) + 1)]
    cases += [(f"SPDX-License-Identifier: {order[k]} OR (({order[k - 1]} AND {order[k - 2]}) OR {order[k - 3]})\nmain", {order[k - j] for j in range(4)}) for k in range(11)]
    cases += [("SPDX-License-Identifier: " + " OR ".join(["MIT", "ISC"] * 40 + ["Zlib"]), {"MIT", "ISC", "Zlib"})]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id bigint, text string")
    for r in license_scan.scan_licenses(df).collect():
        text, held = cases[r["id"]]
        found = [d for d in r["found"] if d["priority"] == 3]
        assert {d["label"] for d in found} == {names[h] for h in held} - {None}, text
        assert sorted((d["start"], d["length"], d["label"]) for d in r["found"]) == sorted((d[0], d[1], d[4]) for d in plain_license(text)[2])
    assert max(len(r["found"]) for r in license_scan.scan_licenses(df).collect()) == 81


def test_later_versions_outside_of_tags(spark):
    cases = {
        "GPL-2.0-or-later WITH Classpath-exception-2.0": "gpl-2.0+", "under the GPL v3 or any later version": "gpl-3.0+", "GNU LGPL 2.1 or later": "lgpl-2.1+",
        "GNU Lesser General Public License version 2.1 or (at your option) any later version": "lgpl-2.1+", "GNU Affero General Public License v3 or later": "agpl-3.0+",
        "GNU General Public License version 3 or later": "gpl-3.0+", "AGPL 3.0 or later": "agpl-3.0+", "GPL-2.0-only": "gpl-2.0",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    for r in license_scan.scan_licenses(df).collect():
        text = list(cases)[r["id"]]
        longest = max(r["found"], key=lambda d: d["length"])
        assert longest["label"] == cases[text] and not [d for d in r["found"] if d["label"] == cases[text].rstrip("+") != cases[text]], (text, r["found"])


def test_every_identifier_has_a_tag_that_its_rules_find():
    assert {i[0] for i in license_rules.NAMES} - {i[0] for i in license_rules.IDENTIFIERS} <= {"cc"}
    for r in license_rules.rules():
        if r["root"] in ("spdx", license_rules.JOINER, "ed under", "available under"):
            for label, keyword, _ in license_rules.IDENTIFIERS:
                for lead in ("spdx license identifier ", "spdx license identifier mit \x02or ", "released under ", "available under "):
                    norm = f" {lead}{keyword} 0 1 0 clause or later "
                    assert not re.search(r["pattern"], norm) or (r["keyword"] in norm and r["root"] in norm)


def test_rules_hold_their_keyword_and_root():
    rules = license_rules.rules()
    assert len(rules) > 200
    samples = ["cc by", "gnu gpl", "apache license version 2 0", "the mit license", "creative commons attribution sharealike 4 0 international", "public domain"]
    for r in rules:
        for text in samples:
            norm = f" {text} "
            if re.search(r["pattern"], norm):
                assert r["keyword"] in norm and r["root"] in norm


def test_personal_data_matches_plain(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op4_personal_data(spark, sf_dir).collect()}
    for doc_id, text in documents:
        base = plain.base_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[doc_id]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in pii.BASE]
        assert r["spans"].startswith(listed)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123456789.+-@ ()aZ_%é🙂\n:/=\"", max_size=60))
def test_base_spans_on_any_text(text):
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == plain.base_spans(text)


def test_added_spans(spark, odd_documents, no_documents):
    text = 'IBAN: DE89 3704 0044 0532 0130 00, ssn 123-45-6789, account number: 12345678, token = "24be64439e3e49cf46b2d7c9", ftp://bob:pw1@h.org/x, IBAN DE00 1234 5678 9012 3456 00'
    assert [(k, text[a:b]) for k, a, b in pii.spans(text) if k not in pii.BASE] == [
        ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("account", "12345678"), ("secret", "24be64439e3e49cf46b2d7c9"), ("login", "bob:pw1"),
    ]
    got = pii.find_personal_data(odd_documents)
    assert got.count() == odd_documents.count() and got.where("size(spans) > 0").count() == 0
    assert pii.find_personal_data(no_documents).count() == 0


def test_statistics_match_plain(documents):
    texts = [t for _, t in documents] + [None, "", " \n", "a b c d e a b c d e", "x\nx\n\n\nx", "é🙂 中\xa0文\tz"]
    got, features = quality.measure(pa.array(texts, pa.string()))
    assert got.tolist() == [plain.statistics(t) for t in texts]
    assert np.isfinite(features).all()


def test_quality_keeps_good_documents(spark, sf_dir, odd_documents, no_documents):
    """Held-out accuracy: half of the labels train, the other half judges."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs.select("doc_id", "text"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in judged if r["quality"] == 1], [r for r in judged if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good) and sum(r["kept"] for r in bad) <= 0.2 * len(bad)
    assert all(not r["kept"] for r in judged if r["base_failed"])
    got = quality.judge(odd_documents, labels)
    assert got.count() == odd_documents.count() and got.where("text IS NULL AND NOT base_failed").count() == 0
    assert quality.judge(no_documents, labels).count() == 0
    assert quality.judge(odd_documents, labels.where("doc_id < 0")).where("NOT base_failed AND NOT kept").count() == 0


def test_trees_are_monotonic_and_flat():
    draw = np.random.default_rng(0)
    x = draw.random((2000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * draw.random(2000)) > 0.7).astype(float)
    trees = boosting.fit(x, y, np.array([1, 0, -1]))
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    grid = np.linspace(0, 1, 50)
    for row in x[:40]:
        many = np.repeat(row[None], 50, axis=0)
        many[:, 0] = grid
        assert (np.diff(trees.score(many)) >= -1e-12).all()
        many = np.repeat(row[None], 50, axis=0)
        many[:, 2] = grid
        assert (np.diff(trees.score(many)) <= 1e-12).all()
    assert np.allclose(boosting.fit(x, np.ones(2000), np.zeros(3)).score(x[:5]), 0.999)


RULES = [("com", "/", "allow", 0), ("example.com", "/en/", "block", 0), ("www.example.com", "/en/", "allow", 0), ("net", "/es/", "block", 0), ("bad.org", "", "block", 1)]
URLS = {
    "http://a.com/x": ("a.com", "/x", "com/"), "https://EXAMPLE.com/en/1?x": ("example.com", "/en/1", "example.com/en/"), "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
    "http://m.www.example.com/en/?q": ("m.www.example.com", "/en/", "www.example.com/en/"), "http://example.com": ("example.com", "", None), "http://x.net/es": ("x.net", "/es", None),
    "http://x.net/es/#t": ("x.net", "/es/", "net/es/"), "mailto:x": ("", "", None), "http://notcom/": ("notcom", "/", None), None: ("", "", None), "": ("", "", None), "x://y://z.com/": ("y:", "//z.com/", None),
}


@pytest.mark.parametrize("limit", [100, 0])
def test_url_rules(spark, limit):
    urls = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, "http://a.com/x"])], "page_id bigint, url string, host string")
    rules = spark.createDataFrame([*RULES, RULES[0]], url_filter.RULES)
    got = url_filter.judge_urls(urls, rules, broadcast_rules=limit).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["hits"][0] and r["hits"][0]["rule"]) == URLS[r["url"]]
    bad = url_filter.judge_urls(spark.createDataFrame([(1, "http://m.bad.org")], "page_id bigint, url string"), rules, broadcast_rules=limit).first()
    assert bad["hits"][0] is None and bad["hits"][1]["verdict"] == "block"
    assert url_filter.judge_urls(urls.where("page_id < 0"), rules, broadcast_rules=limit).count() == 0
    assert url_filter.judge_urls(urls, rules.where("host = ''"), broadcast_rules=limit).count() == len(URLS) + 1


def test_hosts_of_the_method_are_configuration(spark, sf_dir, tmp_path, monkeypatch):
    """The method's rules block where no rule of the contract fits, and come from a table if one is named."""
    urls = ["http://ads.DoubleClick.net/x", "http://www.example.com/en/", "http://a.net/es/", "https://news.example.org/", None]
    folder = tmp_path / "in"
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{folder}/pages.parquet")
    verdicts = lambda: [r["verdict"] for r in queries.op6_url_filter(spark, str(folder)).orderBy("page_id").collect()]
    assert verdicts() == ["block", "allow", "block", "allow", "allow"]
    spark.createDataFrame([("example.org", "/", "block"), ("net", "", "allow")], "host string, path string, verdict string").write.parquet(f"{tmp_path}/rules")
    monkeypatch.setenv("LEDGERLOOM_URL_RULES", f"{tmp_path}/rules")
    assert verdicts() == ["allow", "allow", "block", "block", "allow"]
