"""Licence scans by canonical digest lookup: entire texts against the digests of known licence texts.

``canonical`` folds case, drops copyright lines and punctuation, brings equivalent spellings together and squeezes blanks;
the digest of what is left is hash-joined to the digests of known texts: those of ``KNOWN`` and ``DIGESTS``, or of a table that the
caller gives. A copyright line starts, after blanks and comment marks, with ``copyright`` and holds a year or a sign, or with
``(c)`` and a year; a clause ``(c) ...`` stays. Punctuation and blanks of any script separate words, so curly quotes, dashes,
no-break spaces and comment marks don't matter.

Defined cases: null texts count as empty; a text with nothing left has a digest but no licence; a null doc_id and
repeated rows are kept; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Spellings that licence matching treats alike.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("authorised", "authorized"), ("favour", "favor"), ("merchantibility", "merchantability"), ("copyright holder", "copyright owner"), ("https", "http"))
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD2 = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD3 = _BSD2.replace("\nTHIS SOFTWARE IS", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS")
_UNLICENSE = 'This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
#: Licence texts (without titles, and with the titles they are often given) and short grants.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", "Released under the MIT License."),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD2), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2),
    ("BSD-3-Clause", _BSD3), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD3),
    ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
)


#: Canonical digests of long licences as they are published, title and appendix included.
DIGESTS = {
    "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184": "Apache-2.0",
    "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e": "GFDL-1.2",
    "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff": "GFDL-1.3",
    "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f": "GPL-1.0",
    "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6": "GPL-2.0",
    "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8": "GPL-3.0",
    "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e": "LGPL-2.0",
    "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}

_COPYRIGHT = r"(^|\n)[ \t]*[#*/;%!-]*[ \t]*(copyright[^\n]{0,120}[0-9]{4}|copyright[ \t]*(\(c\)|©)|©|\(c\)[ \t]*[0-9]{4})[^\n]*"
_APART = r"[^\p{L}\p{M}\p{N}]+"


def canonical(text: Column) -> Column:
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, _COPYRIGHT, "\n")
    x = F.regexp_replace(x, r"all rights reserved", " ")
    x = F.trim(F.regexp_replace(x, _APART, " "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def _canonical_sql(x: str) -> str:
    x = f"lower(coalesce({x}, ''))"
    x = f"regexp_replace({x}, '{_COPYRIGHT}', chr(10), 'g')"
    x = f"regexp_replace({x}, 'all rights reserved', ' ', 'g')"
    x = f"trim(regexp_replace({x}, '{_APART}', ' ', 'g'))"
    for old, new in SPELLINGS:
        x = f"replace({x}, '{old}', '{new}')"
    return x


def license_scan(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, the digest of its canonical text, and the licence that has this digest (null where none has).

    ``known``: (license, text) of the licences to look for; null names and texts are left out, and of several names for one canonical
    text the smallest holds. Without it ``KNOWN`` and ``DIGESTS`` are looked up, few enough to broadcast.
    """
    spark = df.sparkSession
    given = spark.createDataFrame(list(KNOWN), "license string, text string") if known is None else known.select(F.col("license").cast("string").alias("license"), F.col("text").cast("string").alias("text")).where("license IS NOT NULL AND text IS NOT NULL")
    digests = given.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    if known is None:
        digests = digests.union(spark.createDataFrame(list(DIGESTS.items()), "digest string, license string"))
    digests = digests.groupBy("digest").agg(F.min("license").alias("license"))
    found = c.documents(df).select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return found.join(F.broadcast(digests) if known is None else digests, "digest", "left").select("doc_id", "digest", "license")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(c.table(spark, sf_dir, "documents"))


def op6_sql() -> str:
    known = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    long = ", ".join(f"('{digest}', '{k}')" for digest, k in DIGESTS.items())
    return f"""WITH known AS (SELECT digest, min(k) AS license FROM (SELECT sha256({_canonical_sql("t")}) AS digest, k FROM (VALUES {known}) v(k, t) UNION ALL VALUES {long}) GROUP BY 1),
        d AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
        SELECT d.doc_id, d.digest, known.license FROM d LEFT JOIN known USING (digest)"""
