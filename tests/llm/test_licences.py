import textwrap

from tidemark.llm import licenses


def test_notices_are_named_and_others_not(spark):
    told = [f"Some words before. {texts[0].capitalize()}, as of today." for texts in licenses.TEMPLATES.values()]
    docs = [(k, f"A first line.\n{line}\nA last line.") for k, line in enumerate(told)]
    docs += [(100 + k, line) for k, line in enumerate([*licenses.OTHERS, "the harbour licence office was closed all week", "a plain line"])]
    rows = {r["doc_id"]: r for r in licenses.licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, name in enumerate(licenses.TEMPLATES):
        assert name in rows[k]["licences"] and rows[k]["paragraphs"] == [1], name
    assert all(rows[d]["licences"] == [] for d, _ in docs if d >= 100)


def test_skipped_paragraphs_cannot_be_confirmed():
    """Without any anchor a template keeps fewer of its bigrams than confirm it."""
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            pairs = licenses.bigrams(text)
            left = [p for p in pairs if not licenses.anchors(text) & set(p.split())]
            assert len(left) / len(pairs) < licenses.CONFIRMED


def test_a_notice_without_its_usual_word_is_found(spark):
    text = licenses.TEMPLATES["mit"][2].replace("granted", "given")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.licences(docs).first()["licences"] == ["mit"]


def test_edges(edge, nothing):
    rows = licenses.licences(edge).collect()
    assert len(rows) == edge.select("doc_id").distinct().count() and all(r["licences"] == [] for r in rows)
    assert licenses.licences(nothing).count() == 0


def test_wrapped_dual_and_in_line_notices(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
    gpl = licenses.TEMPLATES["gpl-3.0"][2]
    agpl = gpl.replace("GNU General", "GNU Affero General")
    prose = " ".join(["the boats left that harbour before dawn and came home after work"] * 60)
    wrap = lambda text: "\n".join(textwrap.wrap(text, 40))
    cases = [
        (wrap(mit), ["mit"]),
        ("A title\n\n" + wrap(apache), ["apache-2.0"]),
        (wrap(gpl), ["gpl-3.0"]),
        (wrap(agpl), ["agpl-3.0"]),
        ("dual licensed under the MIT license or the Apache License, Version 2.0", ["apache-2.0", "mit"]),
        (f"{prose} {mit} {prose} {apache} {prose}", ["apache-2.0", "mit"]),
        ("licensed under CC BY SA 4.0", ["cc-by-sa"]),
        ("This work is licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa"]),
        (wrap(gpl.replace("version 3", "version 2")), ["gpl-2.0"]),
        ("Licensed under the GNU General Public License version 3", ["gpl-3.0"]),
        ("# SPDX-License-Identifier: MIT\nimport os", ["mit"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0"]),
        (wrap(licenses.TEMPLATES["bsd"][3].capitalize() + ": redistributions of source code must retain the above copyright notice"), ["bsd"]),
        ("permission is hereby granted free of charge to any person\n\nobtaining a copy of this software and associated documentation files", []),
    ]
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.licences(docs).collect()}
    assert {k: rows[k]["licences"] for k in rows} == {k: want for k, (_, want) in enumerate(cases)}
    assert rows[0]["paragraphs"] == [0] and rows[1]["paragraphs"][0] == 2


def test_equal_notices_are_reported_each(spark):
    text = licenses.TEMPLATES["mit"][2]
    docs = spark.createDataFrame([(1, f"{text}\n{text}\n\n{text}")], "doc_id long, text string")
    assert licenses.licences(docs).first()["paragraphs"] == [0, 1, 3]
