"""No operator of this engine is a streaming one: all inputs are bounded tables.

Every operator takes and returns DataFrames, so those without global order
(cleaning, guards, receipts, dimensions) also accept what ``readStream`` gives.
"""
