"""Public licence texts, headers and notices, with their labels and mandatory key phrases.

A template is a label, a text, groups of key phrases, one of each of which must stand in a match, and groups that may
not stand in it. In a group, | parts alternatives; words joined by - stand side by side, and one word may stand between others.
"""

from __future__ import annotations

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. """ + _NO_WARRANTY

_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following."""

_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""


def _gnu(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""


_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/"""

_APACHE_BODY = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION,
AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is
granting the License."""

_MPL_BODY = """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that
creates, contributes to the creation of, or owns Covered Software."""

_EPL_BODY = """Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE
("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."""


def _gnu_body(name: str, version: str, year: str) -> str:
    return f"""{name} Version {version}, {year} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and
distribute verbatim copies of this license document, but changing it is not allowed."""


def _gnu_only(name: str, version: str) -> str:
    return f"""you can redistribute it and/or modify it under the terms of the {name}, version {version}, as published by the Free
Software Foundation. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"""


#: Label, name, phrases of the name, version, its phrases, and year of its text.
_GNU = tuple(
    (f"{short}-{version}", f"GNU {name} License", phrases, version, f"version {digits} | {digits} of-the-license | license v{digits} | license {digits} | {digits} {year} | {year} copyright{more}", year)
    for short, name, phrases, versions in (
        ("gpl", "General Public", "gnu general | general public | gnu public", (("2", "1991"), ("3", "2007"))),
        ("lgpl", "Lesser General Public", "lesser general | gnu lesser | lesser public", (("2.1", "1999"), ("3", "2007"))),
        ("agpl", "Affero General Public", "affero general | gnu affero | affero public", (("3", "2007"),)),
    )
    for version, year in versions
    for digits in (version.replace(".", "-"),)
    for more in (f" | version {digits[0]} 1 | v{digits}" if "." in version else "",)
)
_OTHER_GNU = {"gpl": "lesser general | gnu lesser | affero general | gnu affero", "lgpl": "gnu affero", "agpl": "gnu lesser"}


def _label(label: str) -> str:
    return label if "." in label else f"{label}.0"


def _gnu_templates():
    for label, name, phrases, version, numbers, year in _GNU:
        short = label.split("-")[0]
        for text in (
            _gnu(name, version), _gnu_only(name, version), _gnu_body(name.upper(), version, year),
            f"This work is licensed under the {name}, version {version}", f"licensed under the {name} v{version}",
        ):
            yield _label(label), text, (phrases, numbers), _OTHER_GNU[short]
    for short, phrases in {"lgpl": "lesser general | gnu lesser | lesser public", "agpl": "affero general | gnu affero | affero public"}.items():
        name = next(n for label, n, *_ in _GNU if label.startswith(short))
        yield short, f"under the terms of the {name}", (phrases, "public license | general public | terms of")


#: Parts of the Creative Commons licences.
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}


def _cc_templates():
    for version, scope in (("4.0", "International"), ("3.0", "Unported")):
        at = version.replace(".", "-")
        for code, name in _CC.items():
            name = name.lower()
            keys = (f"{name} {at} | {name} {scope} | {code} {at}",)
            longer = " | ".join(x for other, full in _CC.items() if other.startswith(f"{code}-") for x in (full.lower(), other))
            barred = (longer,) if longer else ()
            yield f"cc-{code}-{version}", f"This work is licensed under a Creative Commons {_CC[code]} {version} {scope} License.", keys, *barred
            yield f"cc-{code}-{version}", f"Licensed under CC {code.upper()} {version}", keys, *barred


#: Identifiers as they stand in notices, and labels other than their lower-case form.
_IDENTIFIERS = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC0-1.0", *[f"CC-{code.upper()}-{v}" for v in ("4.0", "3.0") for code in _CC])
_RENAMED = {"BSL-1.0": "boost-1.0"}


def _notices():
    for name in _IDENTIFIERS:
        words = name.lower().replace(".", "-")
        label = _RENAMED.get(name, name.lower())
        yield label, f"SPDX-License-Identifier: {name}", (f"identifier-{words} | spdx {words} | license-identifier {words}",)
        yield label, f"License: {name}", (f"license-{words}",)


_MIT_NOTICE = ("mit license | mit licence | under the mit | under mit | terms of-the-mit",)
_MPL_KEYS = ("mozilla public | mozilla license | mozilla v | mpl", "2-0 | license v")
_EPL_KEYS = ("eclipse public | eclipse license",)

TEMPLATES = (
    ("mit", _MIT, ("permission is hereby | hereby granted | free-of charge | person obtaining", "merge publish | sublicense and | sell-copies | copies-of-the software | deal in-the software")),
    ("mit", "Released under the MIT License", _MIT_NOTICE),
    ("mit", "This project is licensed under the terms of the MIT license", _MIT_NOTICE),
    ("bsd-2-clause", _BSD_2 + " " + _BSD_END, ("redistributions of source | redistributions in binary | source code must | must reproduce",), "endorse or | or promote | promote products | prior written permission"),
    ("bsd-3-clause", _BSD_2 + " " + _BSD_3 + " " + _BSD_END, ("redistributions of source | redistributions in binary | source code must | must reproduce", "endorse or | or promote | promote products | prior written permission")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use | source and binary | binary forms | use in source",)),
    ("isc", _ISC, ("permission-to use | to-use copy | copy modify", "with-or without fee | without fee | fee is-hereby")),
    ("zlib", _ZLIB, ("not-be misrepresented | be misrepresented | claim-that you | wrote the-original", "redistribute it | it freely | alter it | express or-implied")),
    ("boost-1.0", _BOOST, ("person or organization | or organization obtaining | organization obtaining", "prepare derivative | derivative works | permit third")),
    ("unlicense", _UNLICENSE, ("free-and unencumbered | unencumbered software | and unencumbered", "public domain | released into | anyone is free")),
    ("apache-2.0", _APACHE, ("apache license | apache-org | the apache", "compliance with | except in | version 2-0 | licenses-license | license version | license 2-0")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license | the apache", "2-0")),
    ("apache-2.0", _APACHE_BODY, ("apache license | apache-org", "2-0 | january 2004")),
    *_gnu_templates(),
    ("mpl-2.0", _MPL, _MPL_KEYS),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", _MPL_KEYS),
    ("mpl-2.0", _MPL_BODY, _MPL_KEYS),
    ("epl-2.0", _EPL, _EPL_KEYS, "license-v1 | license-1-0 | license v-1-0"),
    ("epl-2.0", "under the terms of the Eclipse Public License v2.0", _EPL_KEYS, "license-v1 | license-1-0 | license v-1-0"),
    ("epl-2.0", _EPL_BODY, _EPL_KEYS, "license-v1 | license-1-0 | license v-1-0"),
    *_cc_templates(),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ("cc0",)),
    *_notices(),
)
