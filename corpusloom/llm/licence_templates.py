"""Texts that licences are told by: full standard texts, standard headers, titles and SPDX lines; fixed public texts."""

from __future__ import annotations

from importlib import resources

_FILES = {
    "Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
    "MPL-2.0": "MPL-2.0",
}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_BSD_HEADER = "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."
_GNU = {
    "GPL-2.0": ("General", "2", "June 1991"), "GPL-3.0": ("General", "3", "29 June 2007"), "LGPL-2.1": ("Lesser General", "2.1", "February 1999"),
    "LGPL-3.0": ("Lesser General", "3", "29 June 2007"), "AGPL-3.0": ("Affero General", "3", "19 November 2007"),
}
_CC = {"CC-BY": "Attribution", "CC-BY-SA": "Attribution-ShareAlike", "CC-BY-NC": "Attribution-NonCommercial", "CC-BY-ND": "Attribution-NoDerivatives",
       "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0", "0BSD",
         *(f"{name}-4.0" for name in _CC))


def _gnu(name: str, family: str, version: str, date: str) -> list[tuple[str, str]]:
    licence = f"GNU {family} Public License"
    header = [
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {licence} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {licence} for more details.",
        f"You should have received a copy of the {licence} along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ]
    forms = ["\n".join(header), header[0], f"{licence} Version {version}, {date}", f"This work is licensed under the {licence}, version {version}",
             f"{licence}, version {version}", f"under the terms of the {licence} as published by the Free Software Foundation, version {version}"]
    forms += [f"SPDX-License-Identifier: {name}{end}" for end in ("", "-only", "-or-later", "+")]
    return [(name, form) for form in forms]


def texts() -> tuple[tuple[str, str], ...]:
    """``(licence, text)``, several for a licence."""
    folder = resources.files("corpusloom.llm").joinpath("licence_texts")
    rows = [(name, folder.joinpath(f"{file}.txt").read_text("utf-8")) for file, name in _FILES.items()]
    for name, parts in _GNU.items():
        rows += _gnu(name, *parts)
    for name, kind in _CC.items():
        rows += [(f"{name}-4.0", f"Creative Commons {kind} 4.0 International Public License"), (f"{name}-4.0", f"Licensed under a Creative Commons {kind} 4.0 International License")]
    rows += [(name, f"SPDX-License-Identifier: {name}") for name in _SPDX]
    rows += [
        ("MIT", _MIT), ("MIT", f"MIT License\nCopyright (c)\n{_MIT}"), ("MIT", "Licensed under the MIT License"), ("ISC", _ISC),
        ("BSD-2-Clause", f"{_BSD_2}\n{_BSD_END}"), ("BSD-3-Clause", f"{_BSD_2}\n{_BSD_3}\n{_BSD_END}"), ("BSD-3-Clause", _BSD_HEADER),
        ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL),
    ]
    return tuple(rows)
