select doc_id, doc_id % 19 as k, (['GNU AFFERO GENERAL PUBLIC LICENSE
   Version 3, 19 November 2007','GNU Lesser General Public License
	Version 3, 29 June 2007','GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007','GNU GENERAL PUBLIC LICENSE
Version 2, June 1991','Server Side Public License','Elastic License 2.0','Business Source License 1.1','Mozilla Public License Version 2.0','Apache License
 Version 2.0, January 2004','Attribution-NonCommercial 4.0 International','Creative Commons Attribution 4.0 International','CC0 1.0 Universal',
'Redistribution and use in source and binary forms ... Neither the name of the holder','Redistribution and use in source and binary forms are permitted',
'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted',
'Permission is hereby granted, free of charge, to any person obtaining a copy ... without warranty of any kind',
'Altered source versions must be plainly marked as such','This is free and unencumbered software released into the public domain',''])[doc_id % 19 + 1] || chr(10) || text as text
from documents
