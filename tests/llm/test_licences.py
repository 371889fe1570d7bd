"""Licence rules on the original wording of notices and texts: as written, hard-wrapped, and as comments."""

import textwrap

import pytest

from ndspark.llm import licenses
from tests.llm.test_llm import by_id, table

MIT = [
    "MIT License", "Copyright (c) 2024 Some One",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.',
]
APACHE = [
    "Copyright 2024 Some One",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
BSD3 = [*BSD, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]


def gnu(what: str, kind: str, version: str, mark: str = ":") -> list[str]:
    return [
        f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation{',' if mark == ':' else ';'} either version {version} of the License, or (at your option) any later version.",
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.",
        f"You should have received a copy of the GNU {kind} Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>.",
    ]


ISC = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.',
]
ZLIB = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
]
ORIGINALS = {
    "mit-text": MIT, "apache-2.0-header": APACHE, "bsd-2-clause-text": BSD, "bsd-3-clause-text": BSD3, "gpl-3.0-header": gnu("program", "General", "3"), "gpl-2.0-header": gnu("program", "General", "2", ";"),
    "lgpl-2.1-header": gnu("library", "Lesser General", "2.1", ";"), "lgpl-3.0-header": gnu("library", "Lesser General", "3"), "agpl-3.0-header": gnu("program", "Affero General", "3"), "isc-text": ISC, "zlib-text": ZLIB,
    "mpl-2.0-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "bsl-1.0-notice": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "unlicense-text": ["This is free and unencumbered software released into the public domain."],
    "epl-2.0-header": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
}


def forms(paragraphs):
    wrapped = ["\n".join(textwrap.wrap(p, 70, break_long_words=False)) for p in paragraphs]
    lines = "\n\n".join(wrapped).split("\n")
    yield "\n".join(paragraphs)
    yield "\n\n".join(paragraphs)
    yield "Some words before.\n\n" + "\n\n".join(wrapped) + "\n\nAnd after."
    yield "\r\n".join(lines)
    yield "\n".join(f"# {x}".rstrip() for x in lines) + "\n\ncode()\n"
    yield "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */\nint main;"
    yield "\n".join(f"// {x}".rstrip() for x in lines)


def test_original_wording(spark):
    cases = [(rule, text) for rule, paragraphs in ORIGINALS.items() for text in forms(paragraphs)]
    found = by_id(licenses.scan(table(spark, [t for _, t in cases])))
    missed = [(rule, cases[i][1]) for i, (rule, _) in enumerate(cases) if rule not in found[i]["rules"]]
    assert not missed
    assert set(ORIGINALS) <= {r[0] for r in licenses.RULES}
    # a text says what it is, and no more
    allowed = {"bsd-3-clause-text": {"bsd-2-clause-text", "bsd-3-clause-text"}}
    assert all(set(found[i]["rules"]) <= allowed.get(rule, {rule, "apache-2.0-notice"}) for i, (rule, _) in enumerate(cases))


@pytest.mark.parametrize("sentence, licence", [
    ("This project is released under the MIT License.", "MIT"), ("The software is distributed under the terms of the Apache License, Version 2.0.", "Apache-2.0"), ("Our code is licensed under the BSD 3-Clause License", "BSD-3-Clause"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("# SPDX-License-Identifier: MIT", "MIT"), ("Licensed under the GNU General Public License v3.0.", "GPL-3.0"),
])
def test_sentences_in_other_words(spark, sentence, licence):
    found = by_id(licenses.scan(table(spark, [f"First line\n{sentence}\nLast line", f"We said that {sentence} or not"])))
    assert found[0]["licences"] == [licence]


def test_what_is_no_licence(spark):
    texts = ["It isn't released under the MIT License.", "MIT License compatibility is a topic", gnu("program", "General", "3")[1], "\n".join(reversed(BSD3)), "Released under the MIT Licence of 1999, they say"]
    assert all(r["licences"] == [] for r in licenses.scan(table(spark, texts)).collect())


def test_one_native_stage(spark):
    plan = licenses.scan(table(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_tables_are_consistent():
    assert all(any(sign in s for sign in licenses.SIGNS) for s in licenses.KNOWN)
    assert {x for *_, ids in licenses.RULES for x in ids} <= set(licenses.KNOWN.values())
