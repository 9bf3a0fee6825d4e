"""Folding of batches as they arrive; an extension, as the statistics are mergeable."""
