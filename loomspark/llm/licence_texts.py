"""Sentences of public licence texts, the order of them in each licence, SPDX identifiers.

A sentence ends behind ``. ; :`` or at a blank line.  ``<x>`` stands for a name, a year or a project in that place.
"""

from __future__ import annotations

#: Licence -> its sentences in order; the same sentence in two licences is the same sentence.
TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "X11": [
        "Except as contained in this notice, the name of <x> shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from <x>.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of <x> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
        "THIS SOFTWARE IS PROVIDED BY <x> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL <x> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;",
        "LOSS OF USE, DATA, OR PROFITS;",
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at <x>",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
        "You must give any other recipients of the Work or Derivative Works a copy of this License;",
        "You must cause any modified files to carry prominent notices stating that You changed the files;",
    ],
    "GPL": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
        "See the GNU Lesser General Public License for more details.",
        "See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "The licenses for most software are designed to take away your freedom to share and change it.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at <x>.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented;",
        "you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at <x>",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at <x>",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.",
    ],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "YOU JUST DO WHAT THE FUCK YOU WANT TO."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "CC0-1.0": ["To the extent possible under law, <x> has waived all copyright and related or neighboring rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."],
    "CC": [
        "To view a copy of this license, visit <x>",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\").",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\").",
    ],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
}

#: Shortened forms of a sentence that often stand for the whole one: (licence, place of the sentence, form).
SHORT = [
    ("MIT", 0, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", 1, "The above copyright notice and this permission notice shall be included in all copies."),
    ("MIT", 2, "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."),
    ("BSD", 0, "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD", 3, "Neither the name of <x> may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", 3, "The name of <x> may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", 0, "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", 0, "Licensed under the Apache License, Version 2.0 (the License) you may not use this file except in compliance with the License."),
    ("Zlib", 2, "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it"),
    ("EPL", 2, "This program is made available under the terms of the Eclipse Public License v2.0"),
]

#: Licence and the sentences that it is known by, in their order; other known sentences may stand between them.
RULES = [
    ("X11", ["MIT/0", "MIT/1", "MIT/2", "X11/0"]),
    ("MIT", ["MIT/0", "MIT/1", "MIT/2"]),
    ("MIT-0", ["MIT/0", "MIT/2"]),
    ("MIT", ["MIT/0", "MIT/1"]),
    ("BSD-4-Clause", ["BSD/0", "BSD/1", "BSD/2", "BSD/4", "BSD/3"]),
    ("BSD-3-Clause", ["BSD/0", "BSD/1", "BSD/2", "BSD/3"]),
    ("BSD-2-Clause", ["BSD/0", "BSD/1", "BSD/2"]),
    ("Apache-2.0", ["Apache-2.0/5", "Apache-2.0/6"]),
    ("Apache-2.0", ["Apache-2.0/0", "Apache-2.0/1", "Apache-2.0/2", "Apache-2.0/3"]),
    ("Apache-2.0", ["Apache-2.0/0", "Apache-2.0/2", "Apache-2.0/3"]),
    ("Apache-2.0", ["Apache-2.0/0", "Apache-2.0/1"]),
    ("Apache-2.0", ["Apache-2.0/0"]),
    ("ISC", ["ISC/0"]),
    ("0BSD", ["ISC/3"]),
    ("PostgreSQL", ["PostgreSQL/0"]),
    ("MPL-2.0", ["MPL-2.0/0"]),
    ("Unlicense", ["Unlicense/0"]),
    ("Zlib", ["Zlib/2"]),
    ("BSL-1.0", ["BSL-1.0/0"]),
    ("EPL-1.0", ["EPL/0"]),
    ("EPL-2.0", ["EPL/1"]),
    ("EPL-2.0", ["EPL/2"]),
    ("WTFPL", ["WTFPL/0"]),
    ("WTFPL", ["WTFPL/1"]),
    ("CC0-1.0", ["CC0-1.0/0"]),
    ("CC0-1.0", ["CC0-1.0/1"]),
    ("CC-BY-4.0", ["CC/1"]),
    ("CC-BY-SA-4.0", ["CC/2"]),
    ("GPL-3.0", ["GPL/9", "GPL/6"]),
    ("AGPL-3.0", ["GPL/9", "GPL/7"]),
    ("LGPL-3.0", ["GPL/9", "GPL/8"]),
    ("GPL-2.0", ["GPL/9", "GPL/10"]),
]

#: SPDX identifiers in their canonical spelling.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause "
    "BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 "
    "CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.1 "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 "
    "OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
