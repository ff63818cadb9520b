"""Trades as set operations on signals and bars.

A bar-by-bar position loop is replaced by four independent steps:

* ``configs``  run settings as rows, checked and normalised,
* ``entries``  every eligible signal is a candidate entry,
* ``exits``    each candidate's own exit, found from prices alone,
* ``chain``    one position at a time, then compounding of capital,
* ``equity``   the marked-to-market curve of the accepted trades.

Short trades are handled in *signed* prices (price times -1), so that a stop is
always below, a target always above, and every ratchet is a running maximum.
"""
