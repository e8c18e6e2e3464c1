"""Each rule with its licence's official text, wrapped in several ways."""

import textwrap

from subtide.llm import licenses

MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.',
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
FREE = "This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{comma} either version {n} of the License, or (at your option) any later version."
GPL_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL3 = [FREE.format(mark=":", comma=",", n=3), GPL_REST, "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."]
GPL2 = [FREE.format(mark=";", comma=";", n=2), GPL_REST, "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc."]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
BSD3 = [*BSD, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
ISC = ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]
OWNER = ["Copyright (c) 2020, The Owner", "All rights reserved."]

#: Paragraphs and their licences; each text's recognised sentences are all used up.
OFFICIAL = [
    (["MIT License", "Copyright (c) 2020 The Owner", *MIT], ["MIT"]), (MIT, ["MIT"]), (MIT[:2], ["MIT"]), (APACHE, ["Apache-2.0"]), ([APACHE[0].split(" You may obtain")[0]], ["Apache-2.0"]),
    (GPL3, ["GPL-3.0-or-later"]), (GPL2, ["GPL-2.0-or-later"]), (GPL3[:1], ["GPL-3.0-or-later"]), (GPL2[:1], ["GPL-2.0-or-later"]),
    (BSD3, ["BSD-3-Clause"]), (BSD, ["BSD-2-Clause"]), ([*OWNER, *BSD3], ["BSD-3-Clause"]), ([*OWNER, *BSD], ["BSD-2-Clause"]), (ISC, ["ISC"]),
    (["This project is licensed under the MIT License."], ["MIT"]), (["SPDX-License-Identifier: MIT"], ["MIT"]), (["Licensed under the Apache License, Version 2.0."], ["Apache-2.0"]),
    (["SPDX-License-Identifier: Apache-2.0"], ["Apache-2.0"]), (["SPDX-License-Identifier: GPL-3.0-only"], ["GPL-3.0-only"]),
    (["This work is licensed under the GNU General Public License, version 3."], ["GPL-3.0-only"]), (["This work is licensed under the GNU General Public License, version 2."], ["GPL-2.0-only"]),
    (["This work is licensed under CC BY-NC 4.0."], ["CC-BY-NC-4.0"]), (["This work is licensed under CC BY-SA 4.0."], ["CC-BY-SA-4.0"]), (["This work is licensed under CC BY 4.0."], ["CC-BY-4.0"]),
    (["Dedicated to the public domain under a CC0 1.0 license."], ["CC0-1.0"]), (["All rights reserved."], ["Proprietary"]), (OWNER, ["Proprietary"]),
]


def test_official_texts(spark):
    rows = []
    for n, (paragraphs, _) in enumerate(OFFICIAL):
        for k, (width, lead, end) in enumerate([(40, "", "\n"), (60, "# ", "\n"), (72, " * ", "\r\n"), (78, "    ", "\n"), (9999, "", "\n")]):
            lines = (end + lead.rstrip() + end).join((end + lead).join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in paragraphs)
            rows.append((n * 10 + k, f"A first line.{end}{end}{lead}{lines}{end}{end}A last line."))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for d, r in got.items():
        assert r["licenses"] == OFFICIAL[d // 10][1], (text[d], r["sentence_ids"])
        assert r["rest_ids"] == [], text[d]
    assert len(got) == 5 * len(OFFICIAL)


def sentence(k):
    kind, _, name = k.partition("-")
    if k in licenses.SENTENCES:
        return licenses.SENTENCES[k][-1]
    known = {"ref": "this library is licensed under the terms of the ", "title": "the ", "spdx": licenses.SPDX}[kind]
    return known + (next(i for i, x in licenses.IDENTIFIERS.items() if x == name) if kind == "spdx" else licenses.NAMES[name][-1])


def test_every_rule(spark):
    rows = [(n, ".\n".join(sentence(k).upper() for k in run) + ". A licence.") for n, (_, run) in enumerate(licenses.RULES)]
    # an unknown sentence between two of a run's parts it
    rows += [(1000 + n, ". Something else. ".join(map(sentence, run)) + ". A permission.") for n, (_, run) in enumerate(licenses.RULES) if len(run) > 1]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, (name, run) in enumerate(licenses.RULES):
        assert got[n]["licenses"] == [name] and got[n]["sentence_ids"] == run and got[n]["rest_ids"] == [], (name, run)
        if len(run) > 1:
            single = [rule for rule, ids in licenses.RULES if len(ids) == 1 and ids[0] in run]
            assert got[1000 + n]["licenses"] == list(dict.fromkeys(single)) and got[1000 + n]["sentence_ids"] == run
    # every way of naming a licence
    rows = list(enumerate(f"Released under the {name}." for name in licenses.NAMED))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[n] for n in range(len(rows))] == [[k] for k in licenses.NAMED.values()]


def test_notices_of_files(spark):
    rows = [
        (1, "/*\n * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint x;"),
        (2, "-- This library is free software; you can redistribute it and/or\n-- modify it under the terms of the GNU Lesser General Public\n-- License as published by the Free Software Foundation; either\n-- version 2.1 of the License, or (at your option) any later version.\n"),
        (3, "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans."),
        (4, "// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt)"),
        (5, "# This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        (6, "MIT License\n\nWe like the permission of the author."), (7, "The MIT wants a licence to teach."),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MPL-2.0"], 2: ["LGPL-2.1-or-later"], 3: ["Unlicense"], 4: ["BSL-1.0"], 5: ["AGPL-3.0-or-later"], 6: [], 7: []}


def test_paragraphs_are_not_joined(spark):
    rows = [(1, "SPDX-License-Identifier:\n\nMIT"), (2, "All rights\n\nreserved."), (3, "Not all rights reserved."), (4, "all rights reserved by others")]
    assert all(r["licenses"] == [] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
