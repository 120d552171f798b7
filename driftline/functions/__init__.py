"""Column functions of the operators, for queries of one's own."""

from driftline.operators.flow import ratio, trade_id
from driftline.operators.normalize import address, number, positive, swap_side
from driftline.operators.screening import clamp, holder_shares, reasons, verdict

__all__ = ["address", "clamp", "holder_shares", "number", "positive", "ratio", "reasons", "swap_side", "trade_id", "verdict"]
