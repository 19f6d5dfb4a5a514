"""Licence notices that are wrapped over lines, in comments, or several on one line."""

import pytest

from leafmill.llm import license_scan as S

MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met:"""
APACHE = """dnl Licensed under the Apache License, Version 2.0 (the "License");
dnl you may not use this file except in compliance with the License."""
NC = "This work is licensed under a Creative Commons Attribution-\nNonCommercial 4.0 International License."
ONE_LINE = "First some words. " + MIT.replace("\n", " ") + " More words stand here. " + " ".join(BSD.replace(" *", "").split()) + " And the end."


@pytest.fixture(scope="module")
def notices():
    return S.Notices(S.Classifier().fit(["plain words of no use here", "the general public was under the bridge"]), 0.9, 0.8)


@pytest.mark.parametrize(
    ("notice", "want"),
    [(MIT, [("mit", "Permission", "to deal")]), (GPL, [("gpl", "# This program is free", "License, or"), ("gpl", "# This program is dist", "See the")]),
     (BSD, [("bsd", " * Redist", "met:")]), (APACHE, [("apache", "dnl Lic", "the License.")]), (NC, [("cc-by-nc", "This work", "License.")])],
)
@pytest.mark.parametrize("before", ["", "İ some prose under it\n\n", "int x = 1;\r\n"])
def test_wrapped(notices, notice, want, before):
    text = before + notice + "\nint main() {}\n"
    got = notices(text)
    assert [f["family"] for f in got] == [w[0] for w in want]
    for f, (_, first, last) in zip(got, want, strict=True):
        own = text[f["start"] : f["stop"]]
        assert own.startswith(first) and own.endswith(last)


def test_several_families(notices, spark):
    assert [f["family"] for f in notices(ONE_LINE)] == ["bsd", "mit"]
    assert [f["family"] for f in notices("\n".join([MIT, "", GPL, "", BSD]))] == ["mit", "gpl", "gpl", "bsd"]
    docs = spark.createDataFrame([(1, ONE_LINE), (2, MIT), (3, GPL), (4, BSD), (5, "no notice\nunder the bridge\nof the public"), (6, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_licences"], r["families"]) for r in S.licence_report(docs).collect()}
    assert got == {1: (2, "bsd,mit"), 2: (1, "mit"), 3: (2, "gpl"), 4: (1, "bsd"), 5: (0, ""), 6: (0, "")}
