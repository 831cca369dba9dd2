"""Lines labelled by hand that no field is trained on, in forms that the four fixed patterns miss: ``<kind|value>`` marks personal data."""

# Labelled lines.
LINES = """
Please call <phone|(415) 555-0132> before noon.
My cell is <phone|415-555-0177>, the office closes at 5.
Fax: <phone|020 7946 0958>
Reach the desk on <phone|0161 496 0345> or in room 214.
Ring <phone|555.201.4477> and ask for Ana.
Tel.<phone|(030) 901 8200>; ask for extension 12
The hotline <phone|0049 30 901 820> is open from 08:30 to 17:00.
Contact us at <phone|1-202-555-0143>.
Order 20417 was confirmed by <phone|(312) 555-0190> on 2023-11-02.
numbers <phone|212-555-0111> and <phone|212-555-0112> ring in the same room
Write to <email|maria.lopez [at] example [dot] org> for a copy.
His address is <email|tom (at) example (dot) net>.
<email|info [at] city.example.com> answers within two days
Send the form to <email|jörg@exämple.de> please
Contact: <email|k.lee [at] example.com>, thanks
mail <email|root@localhost> when the job fails
The bot writes from <email|no-reply[at]example[dot]com> only.
Ask <email|anna@bücher.example> about the index.
The host <ip|2001:db8:85a3::8a2e:370:7334> timed out.
ping <ip|fe80::1ff:fe23:4567:890a> failed twice
Blocked <ip|10[.]20[.]30[.]40> after 14 attempts
route via <ip|2001:db8::1> and restart
Traffic from <ip|2001:0db8:0000:0000:0000:ff00:0042:8329> was dropped
Server <ip|192(.)168(.)7(.)21> is down
Paid with <card|4111.1111.1111.1111> yesterday.
Card <card|5500/0000/0000/0004> was declined
the number <card|4012_8888_8888_1881> is on file
Use <card|4242 - 4242 - 4242 - 4242> for the test
The meeting of 2024-03-15 starts at 10:30 in room 12.
Version 3.11.4 fixes 27 bugs of 3.10.
About 1,250,000 people live within 30 km of the coast.
Chapter 4, pages 112-131, covers the years 1914-1918.
The score was 3-2 after 90 minutes and 5 corners.
Invoice 2023/00417 over $1,299.00 is due on 01.12.2023.
ISBN 978-0-13-468599-1 is out of print.
It measured 12.5 by 40.25 by 3.75 cm.
Flight 447 left at 22:29 and climbed to 35000 feet.
The library opens at 9 and closes at 18 on weekdays.
Set the ratio to 16:9 and the rate to 29.97.
We meet at noon at the corner dot the usual place.
Log 2022-07-01T12:00:05 status 200 bytes 51234
Numbers 4111 1111 1111 1112 and 1234 5678 1234 5678 are no cards.
The mask is 255.255.255.300 by mistake.
See section 2.3.1.4.5 and table 7.
between 100 200 and 300 400 rows were read
Protocol 10::20 is not defined for ratio 3:1.
""".strip().split("\n")

