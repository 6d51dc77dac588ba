"""License texts as templates: the wording, with optional and replaceable regions marked."""

from __future__ import annotations

_RIGHTS = '<<beginOptional>><<var;name="title";match=".{0,120}">> license<<endOptional>> '
_COPYRIGHT = '<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;name="copyright";match=".{0,400}">> <<beginOptional>>all rights reserved<<endOptional>><<endOptional>> '
_SUBJECT = '<<beginOptional>>this <<var;name="subject";match=".{0,40}">> is<<endOptional>> '
_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<beginOptional>><<var;name="bullet";match=".{1,2}">><<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<beginOptional>><<var;name="bullet";match=".{1,2}">><<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution """
_BSD_TAIL = """this software is provided by <<var;name="holder";match=".{1,200}">> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
in no event shall <<var;name="holder";match=".{1,200}">> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_GNU_TAIL = """<<var;name="program";match=".{1,60}">> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details
<<beginOptional>>you should have received a copy of the gnu {name} along with <<var;name="program";match=".{{1,60}}">> if not <<beginOptional>>see <<var;name="place";match=".{{0,60}}">><<endOptional>><<beginOptional>>write to the free software foundation inc <<var;name="place";match=".{{0,120}}">><<endOptional>><<endOptional>>"""


def _gnu(name: str, version: str, later: str) -> str:
    head = f'<<var;name="program";match=".{{1,60}}">> is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation '
    which = f"either version {version} of the license or at your option any later version " if later else f"version {version} <<beginOptional>>of the license<<endOptional>> "
    tail = _GNU_TAIL.replace("{name}", name).replace("{{", "{").replace("}}", "}")
    return head + which + tail


TEMPLATES = {
    "mit-notice": _SUBJECT + "released under the mit license",
    "apache-2.0-notice": "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0 <<beginOptional>>the license<<endOptional>>",
    "gpl-3.0-notice": _SUBJECT + "licensed under the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "cc-by-nc-4.0-notice": _SUBJECT + "licensed under <<beginOptional>>a<<endOptional>> cc by nc 4 0 <<beginOptional>>international license<<endOptional>>",
    "cc-by-4.0-notice": "this work is licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution 4 0 international license",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> <<beginOptional>>www<<endOptional>> mozilla org mpl 2 0",
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
    "mit-text": _RIGHTS + _COPYRIGHT + """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall <<var;name="holders";match=".{1,200}">> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "isc-text": _RIGHTS + _COPYRIGHT + """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and <<var;name="holder";match=".{1,200}">> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
        in no event shall <<var;name="holder";match=".{1,200}">> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "bsd-2-clause-text": _COPYRIGHT + _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause-text": _COPYRIGHT + _BSD_HEAD + '<<beginOptional>><<var;name="bullet";match=".{1,2}">><<endOptional>> neither the name of <<var;name="organization";match=".{1,200}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission ' + _BSD_TAIL,
    "zlib-text": _COPYRIGHT + """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        <<beginOptional>>1<<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        <<beginOptional>>2<<endOptional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        <<beginOptional>>3<<endOptional>> this notice may not be removed or altered from any source distribution""",
    "unlicense-text": """this is free and unencumbered software released into the public domain
        anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
        in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
        we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
        we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
        <<beginOptional>>for more information please refer to <<var;name="place";match=".{0,40}">><<endOptional>>""",
    "gpl-2.0-only-header": _gnu("general public license", "2", ""),
    "gpl-2.0-or-later-header": _gnu("general public license", "2", "later"),
    "gpl-3.0-only-header": _gnu("general public license", "3", ""),
    "gpl-3.0-or-later-header": _gnu("general public license", "3", "later"),
    "lgpl-2.1-or-later-header": _gnu("lesser general public license", "2 1", "later"),
    "lgpl-3.0-or-later-header": _gnu("lesser general public license", "3", "later"),
    "agpl-3.0-or-later-header": _gnu("affero general public license", "3", "later"),
    "wtfpl-text": "<<beginOptional>>everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed<<endOptional>> do what the fuck you want to public license terms and conditions for copying distribution and modification <<beginOptional>>0<<endOptional>> you just do what the fuck you want to",
}
