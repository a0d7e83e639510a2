"""Colour values of style sheets as Column expressions: names, hexadecimal forms, rgb(), hsl() and hwb()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let
from .numbers import hex_colour

#: The named colours of the published standard.
NAMED = """
aliceblue=f0f8ff antiquewhite=faebd7 aqua=00ffff aquamarine=7fffd4 azure=f0ffff beige=f5f5dc bisque=ffe4c4 black=000000 blanchedalmond=ffebcd
blue=0000ff blueviolet=8a2be2 brown=a52a2a burlywood=deb887 cadetblue=5f9ea0 chartreuse=7fff00 chocolate=d2691e coral=ff7f50 cornflowerblue=6495ed
cornsilk=fff8dc crimson=dc143c cyan=00ffff darkblue=00008b darkcyan=008b8b darkgoldenrod=b8860b darkgray=a9a9a9 darkgreen=006400 darkgrey=a9a9a9
darkkhaki=bdb76b darkmagenta=8b008b darkolivegreen=556b2f darkorange=ff8c00 darkorchid=9932cc darkred=8b0000 darksalmon=e9967a darkseagreen=8fbc8f
darkslateblue=483d8b darkslategray=2f4f4f darkslategrey=2f4f4f darkturquoise=00ced1 darkviolet=9400d3 deeppink=ff1493 deepskyblue=00bfff dimgray=696969
dimgrey=696969 dodgerblue=1e90ff firebrick=b22222 floralwhite=fffaf0 forestgreen=228b22 fuchsia=ff00ff gainsboro=dcdcdc ghostwhite=f8f8ff gold=ffd700
goldenrod=daa520 gray=808080 green=008000 greenyellow=adff2f grey=808080 honeydew=f0fff0 hotpink=ff69b4 indianred=cd5c5c indigo=4b0082 ivory=fffff0
khaki=f0e68c lavender=e6e6fa lavenderblush=fff0f5 lawngreen=7cfc00 lemonchiffon=fffacd lightblue=add8e6 lightcoral=f08080 lightcyan=e0ffff
lightgoldenrodyellow=fafad2 lightgray=d3d3d3 lightgreen=90ee90 lightgrey=d3d3d3 lightpink=ffb6c1 lightsalmon=ffa07a lightseagreen=20b2aa
lightskyblue=87cefa lightslategray=778899 lightslategrey=778899 lightsteelblue=b0c4de lightyellow=ffffe0 lime=00ff00 limegreen=32cd32 linen=faf0e6
magenta=ff00ff maroon=800000 mediumaquamarine=66cdaa mediumblue=0000cd mediumorchid=ba55d3 mediumpurple=9370db mediumseagreen=3cb371
mediumslateblue=7b68ee mediumspringgreen=00fa9a mediumturquoise=48d1cc mediumvioletred=c71585 midnightblue=191970 mintcream=f5fffa mistyrose=ffe4e1
moccasin=ffe4b5 navajowhite=ffdead navy=000080 oldlace=fdf5e6 olive=808000 olivedrab=6b8e23 orange=ffa500 orangered=ff4500 orchid=da70d6
palegoldenrod=eee8aa palegreen=98fb98 paleturquoise=afeeee palevioletred=db7093 papayawhip=ffefd5 peachpuff=ffdab9 peru=cd853f pink=ffc0cb plum=dda0dd
powderblue=b0e0e6 purple=800080 rebeccapurple=663399 red=ff0000 rosybrown=bc8f8f royalblue=4169e1 saddlebrown=8b4513 salmon=fa8072 sandybrown=f4a460
seagreen=2e8b57 seashell=fff5ee sienna=a0522d silver=c0c0c0 skyblue=87ceeb slateblue=6a5acd slategray=708090 slategrey=708090 snow=fffafa
springgreen=00ff7f steelblue=4682b4 tan=d2b48c teal=008080 thistle=d8bfd8 tomato=ff6347 turquoise=40e0d0 violet=ee82ee wheat=f5deb3 white=ffffff
whitesmoke=f5f5f5 yellow=ffff00 yellowgreen=9acd32
"""
#: Names whose colour the reader's system decides.
SYSTEM_NAMES = (
    "accentcolor", "accentcolortext", "activetext", "buttonborder", "buttonface", "buttontext", "canvas", "canvastext", "field", "fieldtext",
    "graytext", "highlight", "highlighttext", "linktext", "mark", "marktext", "selecteditem", "selecteditemtext", "visitedtext",
)
SPACE = r"[ \t\n\r\f]++"
NUMBER = r"[+-]?(?:[0-9]++(?:\.[0-9]++)?|\.[0-9]++)(?:e[+-]?[0-9]++)?"


def _number(text: Column) -> Column:
    """A number as style sheets write it, infinite beyond the range; null for other text."""
    return F.when(F.regexp_like(text, F.lit(f"^{NUMBER}$")), text.try_cast("double"))


def _amount(text: Column, scale: float, top: float) -> Column:
    """A number times scale or a percentage of top, from 0 to top; none is 0; null for other text."""
    share = F.endswith(text, F.lit("%"))
    n = _number(F.when(share, F.left(text, F.length(text) - 1)).otherwise(text))
    bounded = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(top)))
    return F.when(text == "none", 0.0).otherwise(let(F.when(share, n / 100 * top).otherwise(n * scale), bounded))


def _hue(text: Column) -> Column:
    """struct<ok, degrees>: from 0 to 360, none is 0; ok is false for other text, degrees null beyond the range of numbers."""
    unit = F.regexp_extract(text, f"^{NUMBER}(turn|grad|rad|deg)?$", 1)
    factor = F.when(unit == "turn", 360.0).when(unit == "grad", 0.9).when(unit == "rad", F.degrees(F.lit(1.0))).otherwise(1.0)
    n = _number(F.left(text, F.length(text) - F.length(unit)))
    finite = lambda x: F.abs(x) <= 1.7976931348623157e308

    def of(turned: Column) -> Column:
        rest = turned % 360
        return F.when(finite(turned), F.when(rest < 0, rest + 360).otherwise(rest))

    degrees = F.when(text == "none", 0.0).otherwise(let(n * factor, of))
    return F.struct(F.coalesce((text == "none") | finite(n), F.lit(False)).alias("ok"), degrees.alias("degrees"))


def _wheel(hue: Column, saturation: Column, light: Column) -> list[Column]:
    """Red, green and blue of a hue by the standard's closed form: each is the light moved by at most min(l, 1 - l) times the saturation."""
    reach = saturation * F.least(light, 1 - light)
    at = lambda k: let((hue / 30 + k) % 12, lambda x: light - reach * F.greatest(F.least(x - 3, 9 - x, F.lit(1.0)), F.lit(-1.0)))
    return [at(0), at(8), at(4)]


def _result(status: str, rgb: list | None = None, alpha=None) -> Column:
    values = [*(rgb or [None] * 3), alpha]
    return F.struct(F.lit(status).alias("status"), *[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip("rgba", values, strict=True)])


def _parts(body: Column) -> Column:
    """struct<legacy, ok, channels, alpha> of what stands between the brackets; alpha is empty where there is none."""
    commas = F.transform(F.split(body, ","), lambda p: F.regexp_replace(p, rf"^{SPACE}|(?<![ \t\n\r\f]){SPACE}$", ""))
    halves = F.split(body, "/")
    words = lambda t: F.filter(F.split(t, SPACE), lambda w: w != "")
    legacy = F.contains(body, F.lit(","))
    found = F.struct(legacy.alias("legacy"), commas.alias("commas"), words(F.get(halves, F.lit(0))).alias("words"), words(F.get(halves, F.lit(1))).alias("alpha"), F.size(halves).alias("halves"))

    def of(p: Column) -> Column:
        listed = (F.size(p["commas"]).isin(3, 4)) & ~F.exists(p["commas"], lambda x: x == "") & (p["halves"] == 1)
        spaced = (F.size(p["words"]) == 3) & ((p["halves"] == 1) | ((p["halves"] == 2) & (F.size(p["alpha"]) == 1)))
        alpha = F.when(p["legacy"], F.get(p["commas"], F.lit(3))).otherwise(F.get(p["alpha"], F.lit(0)))
        return F.struct(p["legacy"].alias("legacy"), F.when(p["legacy"], listed).otherwise(spaced).alias("ok"), F.when(p["legacy"], F.slice(p["commas"], 1, 3)).otherwise(p["words"]).alias("channels"), F.coalesce(alpha, F.lit("")).alias("alpha"))

    return let(found, of)


def _function(name: Column, body: Column) -> Column:
    """The colour of rgb(), rgba(), hsl(), hsla() or hwb() with this between the brackets."""

    def of(p: Column) -> Column:
        channel = lambda i: F.get(p["channels"], F.lit(i))
        percent = lambda i: F.endswith(channel(i), F.lit("%"))
        alpha = F.when(p["alpha"] == "", 1.0).otherwise(_amount(p["alpha"], 1, 1.0))
        missing = p["legacy"] & (F.array_contains(p["channels"], "none") | (p["alpha"] == "none"))
        invalid, unsupported = _result("invalid"), _result("unsupported")
        whole = lambda rgb: let(F.struct(*[x.alias(n) for n, x in zip("rgba", [*rgb, alpha], strict=True)]), lambda x: F.when(x["r"].isNull() | x["g"].isNull() | x["b"].isNull() | x["a"].isNull(), invalid).otherwise(_result("known", [x["r"], x["g"], x["b"]], x["a"])))
        mixed = p["legacy"] & ((percent(0) != percent(1)) | (percent(0) != percent(2)))
        rgb = F.when(mixed, invalid).otherwise(whole([_amount(channel(i), 1, 255.0) / 255 for i in range(3)]))
        bare = p["legacy"] & ~(percent(1) & percent(2))
        unmarked = p["legacy"] | F.exists(F.slice(p["channels"], 2, 2), lambda x: (x != "none") & ~F.endswith(x, F.lit("%")))
        hwb = name == "hwb"
        values = F.struct(_hue(channel(0)).alias("hue"), _amount(channel(1), 0.01, 1.0).alias("x"), _amount(channel(2), 0.01, 1.0).alias("y"))

        def turned(v: Column) -> Column:
            rest = 1 - v["x"] - v["y"]
            drawn = F.struct(v["hue"]["degrees"].alias("h"), F.when(hwb, 1.0).otherwise(v["x"]).alias("s"), F.when(hwb, 0.5).otherwise(v["y"]).alias("l"), F.when(~hwb, 1.0).when(rest <= 0, 0.0).otherwise(rest).alias("factor"), F.when(~hwb, 0.0).when(rest <= 0, v["x"] / (v["x"] + v["y"])).otherwise(v["x"]).alias("white"))
            rgb = let(drawn, lambda d: whole([c * d["factor"] + d["white"] for c in _wheel(d["h"], d["s"], d["l"])]))
            return F.when(~v["hue"]["ok"], invalid).when(v["hue"]["degrees"].isNull(), unsupported).when(F.when(hwb, unmarked).otherwise(bare), invalid).otherwise(rgb)

        of_hue = F.when(hwb & p["legacy"], invalid).otherwise(let(values, turned))
        return F.when(~p["ok"] | missing, invalid).when(name.isin("rgb", "rgba"), rgb).otherwise(of_hue)

    return let(_parts(body), of)


def css_colour(text: Column) -> Column:
    """struct<status, r, g, b, a>, numbers from 0 to 1, of a colour value, in any case and with white space around it.

    status is known, unsupported (another function, relative or nested ones, a colour of the system, a hue beyond
    the range of numbers) or invalid; only known colours have numbers. Null text gives null.
    """

    def of(t: Column) -> Column:
        call = r"(?s)^([^(]++)\((.*)\)$"
        named = F.try_element_at(F.str_to_map(F.lit(" ".join(NAMED.split())), F.lit(" "), F.lit("=")), t)
        read = F.struct(t.alias("t"), F.regexp_extract(t, call, 1).alias("name"), F.regexp_extract(t, call, 2).alias("body"), F.coalesce(F.concat(F.lit("#"), named), t).alias("code"))

        def told(x: Column) -> Column:
            plain = let(hex_colour(x["code"]), lambda c: F.when(c.isNull(), _result("invalid")).otherwise(_result("known", [c["r"], c["g"], c["b"]], c["a"])))
            nested = F.contains(x["body"], F.lit("(")) | F.contains(x["body"], F.lit("from"))
            return (
                F.when(x["t"] == "transparent", _result("known", [0.0] * 3, 0.0))
                .when(F.startswith(x["code"], F.lit("#")), plain)
                .when(x["name"].isin("rgb", "rgba", "hsl", "hsla", "hwb"), F.when(nested, _result("unsupported")).otherwise(_function(x["name"], x["body"])))
                .when((x["name"] != "") | F.contains(x["t"], F.lit("(")) | x["t"].isin(*SYSTEM_NAMES), _result("unsupported"))
                .otherwise(_result("invalid"))
            )

        return let(read, told)

    trimmed = F.lower(F.regexp_replace(text, rf"^{SPACE}|(?<![ \t\n\r\f]){SPACE}$", ""))
    return F.when(text.isNotNull(), let(trimmed, of))
