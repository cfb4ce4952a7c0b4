"""The subject areas, each assembled from the operators.

Inputs are landed tables and parameter tables; outputs are long frames, one per block.
"""
