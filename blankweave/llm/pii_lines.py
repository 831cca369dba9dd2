"""A small table of lines labelled by hand, for the field over word shapes: ``<kind|value>`` marks personal data."""

from __future__ import annotations

# Labelled lines.
LINES = """
You can phone me on <phone|646-555-0119>, but not on Sundays.
Dial <phone|1-800-555-0166>. It is free of charge.
call <phone|1-312-555-0148> or <phone|(773) 555-0121>, either works
Telephone: <phone|(089) 2180 4410>; fax: <phone|(089) 2180 4411>
The clinic, <phone|0117 496 0712>, takes patients until 17:30.
Her new number is <phone|0171 555 210>.
Ask at <phone|718.555.0103>, please, not by letter.
<phone|(206) 555-0185> is the number of the night porter
WhatsApp <phone|0044 20 7946 0321> for bookings of 4 or more.
It rang at <phone|503-555-0160>: nobody answered.
Drop a line to <email|peter.falk [at] museum [dot] de> by Friday.
<email|sales (at) shop (dot) com> is read once a day.
Her mail, <email|r.ito [at] lab.example.jp>, bounced.
<email|office [at] school.example> knows more about it
Please ask <email|dana (at) firma (dot) net> or <email|olaf (at) firma (dot) net>.
From: <email|webmaster[at]site[dot]info>
Questions go to <email|müller@straße.example>, not to me.
cron writes to <email|backup@storage> every night
Mail <email|lucy [at] choir.org>.
We looked at 12 houses at the lake and at 3 in town.
She is good at chess (at least at 5 minute games).
Peer <ip|2001:db8:1:2::17> is up since 09:14:22.
listen on <ip|fd00:10::5>, port 8080
The packet came from <ip|2001:0db8:0a0b:12f0:0000:0000:0000:0001>.
Do not open <ip|203[.]0[.]113[.]9> in a browser.
seen: <ip|198(.)51(.)100(.)77>, <ip|2001:db8:ffff::3>
They charged <card|5105.1051.0510.5100> twice.
card no. <card|3782/8224/6310/0050>, valid until 11/27
Visa <card|4000_0566_5566_5556> belongs to the firm.
The form shows <card|6011 - 1111 - 1111 - 1117> in box 3.
The train of 07:45 left at 08:10 on 2021-05-30.
From 1989 to 1995 the firm sold 1,400,000 units at $24.99.
Release 2.10.3 follows 2.9.17 and needs 512 MB.
Section 4.2.1, pages 88-97, lists 340 species.
The parcel weighs 12.75 kg and is 40 x 30 x 20 cm large.
Part 4471-220-18 replaces part 4471-219.
ISBN 978-3-16-148410-0 costs 39.90 in shops.
On 03/04/2019 the court heard case 17/2018.
Temperatures fell from 21.5 to 19.25 within 6 hours.
row 10 20 30 and row 40 50 60 add up to 210
The bill 100-200-3000 of 1998 was never passed.
He ran 10 km in 41:22 and won by 0:07.
In 2008, 5 of 27 members voted; 22 stayed away.
Account 0012345 holds 17 items since 1.1.2020.
""".strip().split("\n")


def labelled(lines: list[str] = LINES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Text and (kind, start, end) of every line."""
    out = []
    for line in lines:
        text, spans = "", []
        for i, part in enumerate(line.replace(">", "<").split("<")):
            if i % 2:
                kind, part = part.split("|", 1)
                spans.append((kind, len(text), len(text) + len(part)))
            text += part
        out.append((text, spans))
    return out
