"""Public licence texts, by SPDX id, and one-line notices. Short texts are here, without copyright lines; long ones are files of license_full."""

import re
from importlib import resources

_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

_PLAIN = (
    ("MIT", f"{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}", "MIT License"),
    ("MIT-0", f"{_GRANT}.\n\n{_AS_IS}", "MIT No Attribution"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}", "ISC License"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_AS_IS}", "BSD Zero Clause License"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_AS_IS, "BSD 2-Clause License"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_AS_IS, "BSD 3-Clause License"),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
        "zlib License",
    ),
)



def _forms(text: str) -> list[str]:
    """A long text as it stands, without the advice behind its end, and without what stands around it between double rules."""
    end = re.search(r"END OF TERMS AND CONDITIONS", text)
    ruled = re.split(r"^={60,}$", text, flags=re.M)
    return [text] + ([text[: end.start()], text[: end.end()]] if end else []) + ([ruled[2]] if len(ruled) > 3 else [])


#: (SPDX id, whole text) of the files; what follows ~ in a name tells versions of one text apart.
_FULL = [(f.name.removesuffix(".txt").split("~")[0], t) for f in sorted(resources.files("waymark.llm").joinpath("license_full").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt") for t in _forms(f.read_text("utf-8"))]

#: (SPDX id, whole text): short ones with and without their title, then the long ones.
TEXTS = [(k, t) for k, t, _ in _PLAIN] + [(k, f"{title}\n\n{t}") for k, t, title in _PLAIN] + _FULL

# Names of licences in notices, by SPDX id.
_NAMES = (
    ("MIT", "MIT"), ("MIT", "MIT License"), ("MIT", "MIT license (MIT)"), ("MIT-0", "MIT No Attribution License"), ("ISC", "ISC License"), ("0BSD", "BSD Zero Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("Zlib", "zlib License"),
    ("Unlicense", "Unlicense"), ("BSL-1.0", "Boost Software License 1.0"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"),
    ("MPL-1.1", "Mozilla Public License, Version 1.1"), ("MPL-1.1", "Mozilla Public License 1.1"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("GPL-1.0", "GNU General Public License, version 1"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"), ("LGPL-2.0", "GNU Library General Public License, version 2"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("GFDL-1.2", "GNU Free Documentation License, Version 1.2"), ("GFDL-1.3", "GNU Free Documentation License, Version 1.3"), ("CC0-1.0", "CC0 1.0 Universal"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
)
_PHRASES = ("Licensed under {}.", "Licensed under the {}.", 'Licensed under the {} (the "License");', "Released under {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "Distributed under the {}.")
#: Ids in a file's header; those of the GNU licences say whether later versions count.
_IDS = [(k, f"{k}{end}") for k in dict.fromkeys(k for k, _ in _NAMES) for end in ("", *(("-only", "-or-later", "+") if k.startswith(("GPL", "LGPL", "AGPL", "GFDL")) else ()))]

#: (SPDX id, whole line).
NOTICES = [(k, phrase.format(name)) for k, name in _NAMES for phrase in _PHRASES] + [(k, f"SPDX-License-Identifier: {name}") for k, name in _IDS]
