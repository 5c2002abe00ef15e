"""Texts of licenses and of the notices by which files name them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """A text to look for.

    ``required`` words must be among the aligned ones; ``forbidden`` words, those by which a related license
    differs, must not stand between the first and the last of them.
    """

    license: str
    text: str
    required: tuple[str, ...]
    forbidden: tuple[str, ...] = ()


# The texts of licenses, paragraph by paragraph, and their usual notices.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:"
)
BSD_SOURCE = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
)
BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
BSD_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the organization."
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission."
)
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
    "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this "
    "software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be "
    "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered "
    "from any source distribution."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means."
)
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
    "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
    "Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."

# The GNU licenses: id, name, version, and the words of the related names.
GNU = (
    ("gpl-3.0", "General Public License", "3", ("lesser", "library", "affero")),
    ("gpl-2.0", "General Public License", "2", ("lesser", "library", "affero")),
    ("lgpl-2.1", "Lesser General Public License", "2.1", ("affero",)),
    ("lgpl-3.0", "Lesser General Public License", "3", ("affero",)),
    ("agpl-3.0", "Affero General Public License", "3", ("lesser", "library")),
)
# Creative Commons elements, in short and in words, and their combinations.
CC_ELEMENTS = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
CC_LICENSES = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = {"3.0": "Unported", "4.0": "International"}


def _gnu() -> list[Template]:
    out = []
    for name, title, version, others in GNU:
        needed = ("gnu", *(x for x in ("lesser", "affero") if x in title.lower()), *version.split("."))
        for text in (f"licensed under the GNU {title}, version {version}.", GNU_NOTICE.format(name=title, version=version)):
            out.append(Template(name, text, needed, others))
    return out


def _creative_commons() -> list[Template]:
    out = []
    for name in CC_LICENSES:
        own = name.split("-")
        others = [x for x in CC_ELEMENTS if x not in own]
        words = [CC_ELEMENTS[x] for x in own]
        for version, port in CC_VERSIONS.items():
            number = version[0]
            short = f"Licensed under CC {name.upper()} {version}."
            out.append(Template(f"cc-{name}-{version}", short, ("cc", *own, number), tuple(others)))
            long = f"licensed under a Creative Commons {'-'.join(words)} {version} {port} License."
            forbidden = tuple(CC_ELEMENTS[x].lower() for x in others)
            out.append(Template(f"cc-{name}-{version}", long, ("commons", *(x.lower() for x in words), number), forbidden))
    return out


TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit",)),
    Template("mit", MIT_GRANT, ("permission", "sublicense")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2")),
    Template("apache-2.0", APACHE, ("apache", "compliance", "2")),
    *_gnu(),
    Template("mit", f"{MIT_GRANT} {MIT_REST}", ("permission", "sublicense", "noninfringement")),
    Template("isc", "Released under the ISC License.", ("isc",)),
    Template("isc", ISC, ("permission", "fee")),
    Template("bsd", BSD_GRANT, ("redistribution", "binary")),
    Template(
        "bsd-2-clause", " ".join((BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_DISCLAIMER)), ("redistribution", "retain", "reproduce"),
        ("endorse", "acknowledgement", "acknowledgment"),
    ),
    Template(
        "bsd-3-clause", " ".join((BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_NAMES, BSD_DISCLAIMER)), ("redistribution", "retain", "endorse"),
        ("acknowledgement", "acknowledgment"),
    ),
    Template(
        "bsd-4-clause", " ".join((BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_ADVERTISING, BSD_NAMES, BSD_DISCLAIMER)),
        ("redistribution", "retain", "endorse", "acknowledgement"),
    ),
    Template("zlib", ZLIB, ("misrepresented", "altered")),
    Template("unlicense", UNLICENSE, ("unencumbered", "domain")),
    Template("mpl-2.0", MPL, ("mozilla", "2")),
    Template("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0.", ("mozilla", "2")),
    Template("cc0-1.0", CC0, ("waived", "neighboring")),
    Template("cc0-1.0", "Released under CC0 1.0 Universal.", ("cc0", "1")),
    *_creative_commons(),
)
