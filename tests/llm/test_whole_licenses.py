"""Licence texts as they are published, and every known sentence by itself."""

import pytest

from textflow.llm import licenses

GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
MIT = "MIT License\n\nCopyright (c) 2020 A. Holder\n\n" + GRANT
BSD = """Copyright (c) 2020, A. Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

{1} Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
{2}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
THIRD = """
{0} Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
TEXTS = [
    (MIT, 3, "MIT", ""), (MIT.replace("\n", "\r\n"), 3, "MIT", ""), ("".join(f" * {x}\n" for x in MIT.split("\n")), 3, "MIT", ""),
    (BSD.format("*", "*", ""), 3, "BSD-2-Clause", ""), (BSD.format("1.", "2.", ""), 3, "BSD-2-Clause", ""),
    (BSD.format("*", "*", THIRD.format("*")), 4, "BSD-3-Clause", ""), (BSD.format("1.", "2.", THIRD.format("3.")), 4, "BSD-3-Clause", ""),
    (GPL, 2, "GPL", ""), (GPL.replace("version.", "version"), 2, "GPL", ""),
    ("Licensed under the Apache License, Version 2.0\nReleased under the MIT License\nReleased under the MIT License\nLicensed under CC BY 4.0", 4, "Apache-2.0,CC-BY-4.0,MIT", ""),
    ("Redistributions of source code must retain the above copyright notice and this permission notice shall be included in all copies.", 2, "", "bsd_source,mit_notice"),
]


def test_published_texts_are_whole(spark):
    rows = [(i, t) for i, (t, *_) in enumerate(TEXTS)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (_, n, names, partial) in enumerate(TEXTS):
        assert (got[i].n_sentences, got[i].licenses, got[i].partial) == (n, names, partial), TEXTS[i][0]
    assert got[9].n_licenses == 4


#: A text of every known sentence by itself.
ALONE = {
    "mit_name": "released under the MIT license", "apache2_name": "licensed under the Apache License, version 2.0",
    "gpl2_name": "licensed under the GNU General Public License, version 2", "gpl3_name": "licensed under the GNU General Public License, version 3",
    "cc_by_nc_4": "licensed under CC BY-NC 4.0", "cc_by_4": "licensed under CC BY 4.0",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies",
    "as_is": "The software is provided 'as is', without warranty of any kind",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd_source": "Redistributions of source code must retain the above copyright notice",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd_endorse": "Neither the name of X may be used to endorse or promote products",
    "gpl_free": "X is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl_hope": "X is distributed in the hope that it will be useful, but without any warranty",
}


def test_every_sentence_alone_passes_the_prefilter(spark, duck):
    assert set(ALONE) == set(licenses.SENTENCES)
    rows = list(enumerate(ALONE.values()))
    duck.execute("CREATE OR REPLACE TABLE alone_docs (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO alone_docs VALUES (?, ?)", rows)
    got = sorted(tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r[1] for r in got] == [1] * len(rows)
    assert got == sorted(duck.execute(licenses.scan_sql("alone_docs")).fetchall())
