"""Licence texts in their usual form: hard-wrapped, with comment leaders."""

import textwrap

import pytest

from moorline.llm import licenses

GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT = ["MIT License", "Copyright (c) 2020 Someone", GRANT, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.']
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."
GPL3 = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", HOPE]
GPL2 = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", HOPE]
MPL = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]
APACHE = ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0"]
UNLICENSE = ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]
ISC = ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]
ZLIB = ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."]
BOOST = ["Boost Software License - Version 1.0 - August 17th, 2003", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:']
LGPL = ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."]
AGPL = [GPL3[0].replace("GNU General", "GNU Affero General"), HOPE]
EPL = ["Eclipse Public License - v 2.0", 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.']
CCBYSA = ['By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License ("Public License"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights.']
CCBY = [CCBYSA[0].replace("-ShareAlike", "")]
ZERO = ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.']
NAMED = [*BSD[:3], BSD[3].replace("the copyright holder", "Some Research Institute, Inc.").replace("its contributors", "the project's other contributors")]
MORE = {"Unlicense": UNLICENSE, "ISC": ISC, "Zlib": ZLIB, "BSL-1.0": BOOST, "LGPL-2.1-or-later": LGPL, "AGPL-3.0-or-later": AGPL, "EPL-2.0": EPL, "CC-BY-SA-4.0": CCBYSA, "CC-BY-4.0": CCBY, "0BSD": ZERO}
TEXTS = {"MIT": MIT, "BSD-3-Clause": BSD, "BSD-2-Clause": BSD[:3], "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "MPL-2.0": MPL, "Apache-2.0": APACHE}


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licenses for r in sorted(licenses.scan(df).collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("leader", ["", "  ", "# ", " * ", "// ", ";; ", "-- "])
def test_wrapped_texts(spark, leader):
    names, texts = [], []
    for name, parts in [*TEXTS.items(), *MORE.items(), ("BSD-3-Clause", NAMED)]:
        for width in (40, 70, 76, 80, 10_000):
            for end in ("\n", "\r\n"):
                lines = [x for part in parts for x in [*textwrap.wrap(part, width), ""]]
                names.append(name)
                texts.append("int x;" + end + end.join(leader + x for x in lines) + end + "code()")
    assert found(spark, texts) == names


def test_sentences_end_at_blank_lines_and_marks(spark):
    assert found(spark, ["Released under\n\nthe MIT License", "Released under. The MIT License", "Not released under\nthe MIT License", "Released under\nthe MIT License terms", "Released under\n  the MIT\nLicense\nx", "a \x01released under the MIT License"]) == ["", "", "", "", "MIT", ""]


#: Whole published texts that Debian-like systems carry.
SHELF = "/usr/share/common-licenses"
WHOLE = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "Artistic": ""}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_published_texts(spark, name):
    """As the file stands, and with each paragraph on one line."""
    import os
    import re

    path = f"{SHELF}/{name}"
    if not os.path.exists(path):
        pytest.skip("this system does not carry the text")
    text = open(path, encoding="utf-8", errors="replace").read()
    joined = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text)) if name in ("BSD", "Artistic", "CC0-1.0") else text.replace("\n", "\r\n")
    assert found(spark, [text, joined]) == [WHOLE[name]] * 2


def test_unwrapped_paragraphs(spark):
    """A whole text on one line: marks alone part the sentences."""
    texts = {**TEXTS, **{k: v for k, v in MORE.items() if k not in ("ISC", "BSL-1.0", "EPL-2.0")}}
    del texts["MIT"], texts["Apache-2.0"]
    assert found(spark, [" ".join(x) for x in texts.values()]) == list(texts)


def test_sql_form_finds_wrapped_texts_too(spark, tmp_path):
    import textwrap as w

    import duckdb
    import pyarrow as pa

    rows = [(i, ("\n# " if i % 2 else "\n").join(x for p in parts for x in [*w.wrap(p, 60), ""])) for i, parts in enumerate([*TEXTS.values(), *MORE.values(), NAMED])]
    rows += [(100, "All rights reserved.\nAll rights reserved.\nAll rights reserved."), (101, None), (102, ""), (103, "a: b; c! d?\n\n\x01e. f")]
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})  # noqa: F841
    sql = duckdb.connect().sql(licenses.scan_sql())
    want = sorted(map(str, (dict(zip(sql.columns, r, strict=True)) for r in sql.fetchall())))
    got = sorted(str({c: r[c] for c in sql.columns}) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and sum("BSD-3-Clause" in x for x in got) == 2
