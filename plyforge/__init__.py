"""Layer-inspection and corpus operators, written as DataFrame jobs."""
