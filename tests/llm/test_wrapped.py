"""Licence notices wrapped over lines."""

import math
import random

from helixmill.llm import license_scan


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use"""
BSD = """/* Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the
 *
 * following conditions are met:
 */"""


def test_license_scan_finds_wrapped_notices(spark):
    far = "permission is hereby granted free of charge to any person obtaining a copy\n" + "plain words of prose stand here\n" * 20 + "of this software and associated documentation files the software to deal in the software without restriction"
    texts = [MIT, BSD, "x y z\n" * 50 + MIT.replace("\n", "\r\n# ") + "\ntail\n" + BSD, MIT.replace(" ", "\n"), far, BSD.replace("binary", "b").replace("source", "s")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [got[i].labels for i in range(len(texts))] == ["mit", "bsd", "bsd,mit", "mit", "", ""]
    assert [got[i].score for i in range(4)] == [1.0] * 4 and got[5].score == 0
    assert {(b.block, b.label) for b in got[0].blocks} == {(0, "mit")}


def test_license_windows_equal_brute_force(spark):
    rnd, texts = random.Random(5), []
    for label, template in license_scan.TEMPLATES:
        for _ in range(4):
            w = template.split()
            for _ in range(rnd.randint(0, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["foo", "the", "software"]))
            if rnd.random() < 0.4:
                w.pop(rnd.randrange(len(w)))
            texts.append("".join(x + rnd.choice([" ", " ", "\n"]) for x in ["lead", "a", *w, "of", "tail"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in license_scan.scan(df).collect():
        w, want, best = texts[r.doc_id].split(), set(), 0.0
        lines = [x.split() for x in texts[r.doc_id].split("\n")]
        for label, template in license_scan.TEMPLATES:
            t, n = set(template.split()), len(template.split())
            n += math.ceil(license_scan.SLACK * n)
            for block in [*(x for x in lines if len(x) <= n), *(w[i : i + n] for i in range(len(w)))]:
                if len(t & set(block)) >= math.ceil(license_scan.CONTAINMENT * len(t) - 1e-9):
                    want.add(label)
                    best = max(best, len(t & set(block)) / len(t))
        base = set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(want | base)) and r.score == max(best, 1.0 if base else 0.0), texts[r.doc_id]
