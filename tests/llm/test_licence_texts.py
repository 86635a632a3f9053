"""Whole licence texts, wrapped as they are found in files, and what each of them is."""

import textwrap

from tessera.llm import licenses

OWNER = """Copyright (c) 2020 Jane Doe"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
CC_BY_SA = """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""
CC_BY_NC_ND = """This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."""
CC_ZERO = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software."""


def gpl(kind: str, version: str, thing: str = "program") -> str:
    return f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License along with this {thing}. If not, see <https://www.gnu.org/licenses/>."""


def wrapped(*paragraphs: str, mark: str = "") -> str:
    """Paragraphs filled to 72 columns, each line after a comment mark."""
    text = "\n\n".join(textwrap.fill(p, 72) for whole in paragraphs for p in whole.split("\n\n"))
    return "\n".join((mark + line).rstrip() for line in text.split("\n"))


BSD2 = f"{OWNER}\nAll rights reserved.\n\n" + wrapped(BSD, BSD_DISCLAIMER)
BSD3 = f"{OWNER}\nAll rights reserved.\n\n" + wrapped(BSD, BSD_ENDORSE, BSD_DISCLAIMER)
#: Text and licences, by hand.
EXPECTED = [
    (wrapped("MIT License", OWNER, MIT), "MIT"),
    (OWNER + "\n" + wrapped(MIT), "MIT"),
    (OWNER + " " + MIT.replace("\n\n", " "), "MIT"),
    (wrapped("MIT License", OWNER, MIT, mark="# "), "MIT"),
    (BSD2, "BSD-2-Clause"),
    (wrapped("BSD 3-Clause License") + "\n\n" + BSD3, "BSD-3-Clause"),
    (BSD3 + "\n\n" + BSD3, "BSD-3-Clause"),
    (BSD3 + "\n\n" + BSD2, "BSD-3-Clause,BSD-2-Clause"),
    (BSD3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause"),
    (wrapped("ISC License", OWNER, ISC), "ISC"),
    (wrapped("Copyright 2020 Jane Doe", APACHE), "Apache-2.0"),
    (wrapped("Copyright 2020 Jane Doe", APACHE, mark=" * "), "Apache-2.0"),
    (wrapped(gpl("", "3")), "GPL-3.0"),
    ("prog - what it does\n" + wrapped(OWNER, gpl("", "2")), "GPL-2.0"),
    (wrapped(gpl("", "2").replace("either version 2 of the License, or (at your option) any later version", "version 2")), "GPL-2.0"),
    (wrapped(gpl("Lesser ", "2.1", "library")), "LGPL-2.1"),
    (wrapped(gpl("Lesser ", "3", "library")), "LGPL-3.0"),
    (wrapped(gpl("Affero ", "3")), "AGPL-3.0"),
    (wrapped(gpl("", "3"), gpl("Affero ", "3")), "AGPL-3.0,GPL-3.0"),
    (wrapped(MPL), "MPL-2.0"),
    (wrapped(EPL), "EPL-2.0"),
    (wrapped(UNLICENSE), "Unlicense"),
    (wrapped(CC_BY_SA), "CC-BY-SA"),
    (wrapped(CC_BY_NC_ND), "CC-BY-NC-ND"),
    (wrapped(CC_ZERO), "CC0-1.0"),
    (wrapped(ZLIB), "Zlib"),
    (wrapped(BOOST), "BSL-1.0"),
    ("// SPDX-License-Identifier: MIT\ncode here", "MIT"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"),
    ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", "MIT OR Apache-2.0"),
    ("# SPDX-License-Identifier: MIT\n\n# SPDX-License-Identifier: BSD-2-Clause AND ISC", "MIT,BSD-2-Clause AND ISC"),
    ("SPDX-License-Identifier:", "SPDX"),
    (wrapped(OWNER, MIT, APACHE), "MIT,Apache-2.0"),
    ("It rained. The licence plate was wet.", ""),
]


def test_whole_licence_texts(spark):
    rows = licenses.licence_scan(spark.createDataFrame([(k, text) for k, (text, _) in enumerate(EXPECTED)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.licences) for r in sorted(rows)] == [(k, want) for k, (_, want) in enumerate(EXPECTED)]


def test_every_identifier_is_found_by_its_pattern():
    """Every identifier that a rule needs has a sentence, so no rule is dead."""
    import re

    known = {name for name, _ in licenses.TEXTS + licenses.SENTENCES} | {"UNKNOWN"}
    for _, pattern in licenses.FULL + licenses.RULES:
        assert set(re.findall(r"[A-Za-z][A-Za-z0-9]+", pattern)) <= known, pattern
