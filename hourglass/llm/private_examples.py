"""The small labelled table of operator 10: lines marked by hand, half of them with nothing private.

A mark is ``[kind text]``.  The lines hold what the fixed patterns find and
what they miss (numbers without a plus sign, cards next to each other or with
other marks between, addresses with blanks or without a domain's dot, longer
IP addresses), beside numbers that are no personal data.  All are invented.
"""

from __future__ import annotations

import re

#: Fixed values, marked by hand.
LINES = """
write to [email ann.bell@example.org] before noon
mail [email k.osei+news@mail.example.com] or ask at the desk
contact: [email info@example.net], open all week
her address is [email maria_lopez@uni.example.edu]
cc [email j-p.roux@example.fr] and [email t.roux@example.fr] please
send it to [email root@localhost] on the same machine
reports go to [email admin@intranet] every night
reach me under [email sam @ example.org] if it fails
the old one was [email lee.park @ mail.example.com] until May
[email pat@mailhost] answers all tickets
forward to [email ops@backup01] when it stops
ask [email eva.k@archive] for the keys
the server [ip 10.20.30.40] was down
connect from [ip 192.168.1.17] to [ip 192.168.1.254] only
login from [ip 203.0.113.9] refused
blocked [ip 198.51.100.23] after five tries
his address was [ip 2001:db8:0:1:0:0:0:17] all day
route to [ip fe80:0:0:0:2a1:9cff:fe12:41] is lost
ping [ip 2001:db8:85a3:0:0:8a2e:370:7334] gives no answer
peer [ip 2001:db8:12:4:0:0:9:1] left
card [card 4111 1111 1111 1111] was refused
paid with [card 5500-0000-0000-0004] on Monday
number [card 4012888888881881] is blocked
two cards, [card 4111111111111111 5555555555554444] on file
charge [card 4012888888881881 4111111111111111] in equal parts
card [card 4111.1111.1111.1111] as printed
card [card 5555.5555.5555.4444] expired
paid by [card 4012/8888/8888/1881] last year
the clerk typed [card 4111/1111/1111/1111] twice
refund [card 5105105105105100] in full
on file: [card 4111111111111111!!] keep it safe
see [card 5555555555554444***] there
call [phone +1 (212) 555-0134] now
ring [phone +44 20 7946 0018] after six
fax [phone +49 30 5550 1234] is off
mobile [phone +33 6 55 50 12 34] any time
phone [phone (415) 555-0177] for a table
call [phone (312) 555-0198] or come in
or [phone 212-555-0142] on weekends
dial [phone 646-555-0110] and wait
my number is [phone 303-555-0163] at work
text [phone 702.555.0129] to stop
desk: [phone 808.555.0150] until five
the office, [phone (602) 555-0119], is closed
the shop's number, [phone 718-555-0101], has changed
call us: [phone (503) 555-0175] today
mother's line [phone 917-555-0188] is busy
[phone (206) 555-0123] is the new number
[phone 404-555-0156] rang all day
call [phone (213) 555-0107] and [phone (213) 555-0108] both
version 3 of the license applies
licensed under CC BY-NC 4.0.
see section 2.1 on page 14
General Public License, version 2.
Apache License, Version 2.0 (the "License")
build 1.4.12 was released on 2021-03-04
release 10.2 fixes 17 faults
it took 3.75 seconds for 1,200 rows
on 12/05/1998 at 10:45 they met
from 09:00 to 17:30 on 24.12.2020
in 1914 and again in 1939 war came
page 12 of 250
pages 112-118 of volume 27
chapter 7, verses 3-5
the score was 21-17 after 90 minutes
prices rose 4.5% to $1,249.99 in 2019
order 5927243074273351 was shipped
order 9807915762804490 is late
item 8250913344071286!! is sold out
invoice 7731904426118053 of May
ticket 4417123456789114 is closed
parcel 1234567890123456*** is on its way
id 90001238812 and id 90001238813 differ
numbers 10 20 30 40 50 follow
sum 123456 + 654321 = 777777
population 8,336,817 in 2020
token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
key = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"
commit 3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1 broke it
sha1 7c222fb2927d828af22f592134e8932480637c0d of the file
colour #ff8800 and #00aa33
ISBN 978-0-306-40615-7 in print
ISBN 0-19-852663-6 is out of print
ISSN 0378-5955 since 1978
time 12:34:56 and 23:59:59
at 08:15:00.250 the log ends
ratio 16:9 or 4:3
mac 00:1a:2b:3c:4d:5e of the card reader
call it 5 times, then 10 times
call 911 in need
room 555 on floor 12
see RFC 5322 and RFC 1918
coordinates 48.8566, 2.3522 of the town
about 3.14159 or 22/7
x1 = 3, x2 = 4, y10 = 17
H2O and CO2 at 25 degrees
@home and @work are labels
follow @ann_bell or @lee on the site
the sign @ means at
5 apples @ 2 each
git@v2 was tagged
""".strip().split("\n")
MARK = re.compile(r"\[(email|ip|card|phone) ([^\]]*)\]")


def examples() -> list[tuple[str, list[tuple[int, str, int]]]]:
    """(text without marks, its spans: start, kind, end) of every line."""
    out = []
    for line in LINES:
        text, spans, last = "", [], 0
        for m in MARK.finditer(line):
            text += line[last:m.start()]
            spans.append((len(text), m.group(1), len(text) + len(m.group(2))))
            text += m.group(2)
            last = m.end()
        out.append((text + line[last:], spans))
    return out
